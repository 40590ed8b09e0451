"""Requests for secrets and money in a text, as a table of what is asked for and how.

A kind is a list of verbs that ask, a list of things and, where the thing alone is harmless, a list of places it should go
to. A clause holds a request if a verb stands a few words before a thing (and that before a place), unless the clause
denies it: then what is denied is taken out first, and the rest is looked at. The tables are data: users pass their own."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import words as W


@dataclass(frozen=True)
class Ask:
    """A kind of request; han: the words are Chinese, and gaps are counted in characters."""

    code: str
    verbs: tuple[str, ...]
    things: tuple[str, ...]
    places: tuple[str, ...] = ()
    gap: int = 5
    han: bool = False

    def pattern(self) -> str:
        if not self.places:
            return W.near(self.verbs, self.gap, self.things, han=self.han)
        if self.han:
            return W.near(self.verbs, self.gap, self.places, han=True)
        return f" {W.either(self.verbs)}(?: \\S+){{0,{self.gap}}} {W.either(self.things)}(?: \\S+){{0,{self.gap}}} {W.either(self.places)} "

    def denied(self) -> str:
        """The same after a word that denies or reports it."""
        if self.han:
            return f"{W.either(DENIALS_HAN)}\\S{{0,6}}{self.pattern()}"
        return f" {W.either(DENIALS)}(?: \\S+){{0,3}}{self.pattern()}"


TELL = ("send", "give", "tell", "share", "text", "email", "forward", "type", "enter", "provide", "confirm", "show", "read", "submit", "reply with", "message", "disclose", "hand over", "write down", "dictate", "whatsapp")
DENIALS = (
    "never", "not", "dont", "cannot", "cant", "wont", "without", "nobody", "no one", "shouldnt", "mustnt", "avoid", "refuse to", "no need to", "asks you to", "ask you to", "asked you to", "asking you to", "wants you to",
)
TELL_HAN, DENIALS_HAN = ("发", "给", "告诉", "提供", "回复", "转发", "念", "报", "输入", "说"), ("不要", "请勿", "切勿", "别", "勿", "不会", "不得", "严禁")

ASKS = (
    Ask("one_time_code", TELL, (
        "verification code", "verification codes", "security code", "login code", "one time code", "one time password", "one time passcode", "otp", "sms code", "authentication code", "confirmation code", "access code",
        "two factor code", "2fa code", "six digit code", "6 digit code", "code we sent", "code you received", "code you got")),
    Ask("password_pin", TELL, ("password", "passwords", "passcode", "pin", "pin code", "pin number", "card pin", "atm pin", "login details", "banking details")),
    Ask("recovery_secret", TELL, ("recovery phrase", "seed phrase", "secret phrase", "mnemonic", "mnemonic phrase", "recovery key", "recovery code", "recovery codes", "backup code", "backup codes", "private key", "private keys", "wallet words")),
    Ask("gift_card", (*TELL, "scratch"), ("gift card number", "gift card numbers", "gift card code", "gift card codes", "gift card pin", "card codes", "back of the gift card", "back of the card", "voucher code", "voucher codes", "photo of the gift card")),
    # Cards as a way to pay; a present for somebody has no such purpose.
    Ask("gift_card", ("pay", "settle", "payment", "fee", "fine", "buy", "purchase", "get"), ("gift card", "gift cards", "giftcard", "giftcards", "itunes card", "itunes cards", "steam card", "steam cards", "google play cards"),
        ("clear", "settle", "release", "fee", "fine", "debt", "balance", "tax", "bail", "penalty", "reimburse", "refund you", "pay you back"), gap=6),
    Ask("crypto_transfer", ("move", "transfer", "send", "shift", "deposit", "wire"), ("funds", "money", "savings", "crypto", "cryptocurrency", "bitcoin", "coins", "balance", "assets"), (
        "safe account", "safe wallet", "secure account", "secure wallet", "new wallet", "holding account", "protected account", "protected wallet", "temporary account", "wallet address", "wallet below", "this wallet", "our wallet")),
    Ask("remote_access", ("install", "download", "open", "run", "start", "launch", "get"), ("anydesk", "teamviewer", "ultraviewer", "rustdesk", "quick assist", "quickassist", "screenconnect", "logmein", "remote desktop app", "screen sharing app")),
    Ask("one_time_code", TELL_HAN, ("验证码", "校验码", "动态码", "动态口令", "短信码", "短信验证"), gap=8, han=True),
    Ask("password_pin", TELL_HAN, ("密码", "支付口令"), gap=8, han=True),
    Ask("recovery_secret", TELL_HAN, ("助记词", "私钥", "恢复码"), gap=8, han=True),
    Ask("crypto_transfer", ("转账", "转入", "汇入", "转到", "转移", "存入"), (), ("安全账户", "安全帐户", "指定账户", "新钱包"), gap=10, han=True),
    Ask("remote_access", ("下载", "安装", "打开", "开启"), ("远程控制", "远程协助", "向日葵", "屏幕共享", "共享屏幕"), gap=6, han=True),
)


def found(text: Column, asks: tuple[Ask, ...] = ASKS) -> Column:
    """Codes of the requests in a text, each once, in the order of the table. Takes clauses as W.clauses gives them."""
    def holds(a: Ask) -> Column:
        rest = lambda c: F.regexp_replace(F.replace(c, F.lit(" "), F.lit("  ")), W.spread(a.denied()), " ")
        return F.when(F.exists(text, lambda c: c.rlike(a.pattern()) & rest(c).rlike(W.loose(a.pattern()))), F.lit(a.code))

    return F.array_distinct(F.filter(F.array(*map(holds, asks)), lambda x: x.isNotNull()))


def found_sql(clauses: str, asks: tuple[Ask, ...] = ASKS) -> str:
    def case(a: Ask) -> str:
        rest = f"regexp_replace(replace(c, ' ', '  '), '{W.spread(a.denied())}', ' ', 'g')"
        return f"CASE WHEN len(list_filter({clauses}, lambda c: regexp_matches(c, '{a.pattern()}') AND regexp_matches({rest}, '{W.loose(a.pattern())}'))) > 0 THEN '{a.code}' END"

    # A code may stand for several rows of the table; its first place counts.
    codes = list(dict.fromkeys(a.code for a in asks))
    cases = {c: " OR ".join(f"({case(a)}) IS NOT NULL" for a in asks if a.code == c) for c in codes}
    return "list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '{c}' END" for c, cond in cases.items()) + "], lambda x: x IS NOT NULL)"


def sensitive_requests(df: DataFrame, *, id_cols: list[str], text_col: str, asks: tuple[Ask, ...] = ASKS) -> DataFrame:
    """id columns and codes: array<string>. Texts without any word of the table are not cut into clauses."""
    rows = W.once(df.select(*id_cols, F.col(text_col).alias("_text")), "_plain", W.plain(F.col("_text")))
    things = tuple(dict.fromkeys(w for a in asks for w in (a.things or a.places)))
    some = reduce(lambda x, y: x | y, [F.contains("_plain", F.lit(W.needle(w))) for w in things])
    rows = W.once(rows, "_clauses", F.when(some, W.clauses(F.col("_text"))).otherwise(F.array().cast("array<string>")))
    return rows.select(*id_cols, found(F.col("_clauses"), asks).alias("codes"))
