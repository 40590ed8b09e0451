"""Words of the rules as tables: keyword categories, and the concepts that text-message rules and lures combine.

Everything here is data of a rule set and may be replaced by a user's own tables; nothing in the operators depends on it."""

from __future__ import annotations

from dataclasses import dataclass

from riskloom.functions import words as W

#: Categories with the level of each. Words are looked up in plain texts, so they hold neither apostrophes nor hyphens.
KEYWORDS: dict[str, tuple[str, tuple[str, ...]]] = {
    "urgency": ("high", (
        "urgent", "urgently", "immediately", "right away", "act now", "act fast", "as soon as possible", "asap", "within 24 hours", "within 48 hours", "final notice", "last chance", "expires today", "expires soon", "expiring", "deadline",
        "time sensitive", "do not delay", "dont delay", "respond now", "before midnight", "today only", "hurry", "limited time", "without delay", "last reminder", "final warning", "instantly", "promptly",
        "立即", "马上", "尽快", "紧急", "24小时内", "最后通知", "限时", "逾期", "今天内", "速回")),
    "threats": ("high", (
        "suspended", "suspension", "terminated", "legal action", "locked", "arrest", "arrested", "unauthorized", "unauthorised", "lawsuit", "prosecuted", "prosecution", "court", "warrant", "deactivated", "blocked", "disabled", "frozen",
        "permanently closed", "will be closed", "will be deleted", "lose access", "penalty", "seized", "blacklisted", "compromised", "hacked", "suspicious activity", "unusual activity", "security breach",
        "冻结", "停用", "封号", "逮捕", "传票", "起诉", "违法", "涉嫌", "注销", "异常登录", "账户异常", "强制执行")),
    "financial": ("high", (
        "wire transfer", "bank account", "bank details", "refund", "invoice", "payment", "overdue", "outstanding balance", "bitcoin", "crypto wallet", "gift card", "gift cards", "credit card", "debit card", "direct deposit", "routing number",
        "iban", "swift code", "tax return", "payroll", "billing", "remittance", "money order", "western union", "moneygram", "cash app", "inheritance", "loan", "unpaid", "processing fee", "purchase order", "transaction")),
    "credential": ("high", (
        "verify your account", "verify your identity", "password", "passcode", "confirm your identity", "confirm your account", "login", "log in", "sign in", "security code", "verification code", "one time code", "update your account",
        "update your details", "reset your password", "validate your account", "your credentials", "social security number", "account information", "reactivate your account", "unlock your account", "two factor", "security question", "pin number",
        "验证码", "密码", "身份验证", "登录", "账号", "实名认证", "更新信息", "重新激活", "校验码", "解锁账户")),
    "impersonation": ("medium", (
        "support team", "help desk", "customer service", "customer care", "security team", "account department", "billing department", "it department", "system administrator", "microsoft", "paypal", "amazon", "apple", "google", "netflix",
        "facebook", "instagram", "whatsapp", "dhl", "fedex", "usps", "ups", "irs", "hmrc", "social security administration", "your bank", "human resources", "chief executive", "docusign", "dropbox", "office 365")),
    "deception": ("medium", (
        "winner", "winners", "won", "prize", "congratulations", "free gift", "claim", "lottery", "jackpot", "you have been selected", "youve been selected", "exclusive offer", "guaranteed", "risk free", "no obligation", "click here", "click below",
        "special promotion", "unclaimed", "reward", "bonus", "free trial", "million dollars", "beneficiary", "once in a lifetime", "act of kindness", "secret shopper",
        "中奖", "恭喜", "奖品", "免费领取", "红包", "抽奖", "返利", "点击链接", "幸运用户", "领取奖励")),
    "attachments": ("high", (
        "see attached", "attached file", "attached document", "attached invoice", "open the attachment", "open attachment", "download the attachment", "enable content", "enable macros", "enable editing", "zip file", "encrypted attachment",
        "password protected", "scanned document", "voice message", "new fax", "shared document", "view document", "download document", "review document", "secure document", "html attachment")),
    "tech_scam": ("high", (
        "virus detected", "your computer", "your device", "infected", "malware", "spyware", "trojan", "technical support", "tech support", "remote access", "call our technicians", "windows defender", "license expired", "subscription renewed",
        "firewall", "antivirus", "system alert", "error code", "do not restart", "dont restart", "toll free", "antivirus subscription", "geek squad", "norton", "mcafee")),
    "job_scam": ("medium", (
        "work from home", "work at home", "remote job", "part time job", "earn money", "daily pay", "paid daily", "weekly pay", "no experience", "no experience needed", "easy money", "extra income", "passive income", "hiring now", "we are hiring",
        "flexible hours", "be your own boss", "online job", "data entry job", "mystery shopper", "package handler", "commission", "start today", "quick cash", "financial freedom", "job offer", "recruiter", "recruitment")),
    "social_engineering": ("medium", (
        "are you available", "are you at your desk", "keep this confidential", "between us", "do me a favor", "do me a favour", "i need a favor", "quick task", "quick favor", "im in a meeting", "in a meeting", "cant talk", "cannot talk",
        "dont tell anyone", "do not tell anyone", "trust me", "kindly", "my dear", "dear friend", "god bless", "confidential", "discreet", "send me your number", "whats your number", "text me back", "stranded", "help me out", "surprise for")),
}


@dataclass(frozen=True)
class Concept:
    """What a plain text may hold: any of the words, or any of them with one of then at most gap words later; number: with
    a telephone number after it."""

    words: tuple[str, ...]
    then: tuple[str, ...] = ()
    gap: int = 8
    number: bool = False

    def patterns(self) -> list[str]:
        latin, han = (tuple(w for w in self.words if W.is_han(w) == k) for k in (False, True))
        out = []
        for own, chinese in ((latin, False), (han, True)):
            later = tuple(w for w in self.then if W.is_han(w) == chinese)
            if own and self.number and not chinese:
                out.append(f" {W.either(own)}(?: \\S+){{0,{self.gap}}} \\d[\\d ]{{4,}} ")
            elif own and self.then and later:
                out.append(W.near(own, self.gap if not chinese else 2 * self.gap, later, han=chinese))
            elif own and not self.then:
                out.append(f" {W.either(own)} " if not chinese else W.either(own))
        return out

    def pattern(self) -> str:
        return "|".join(self.patterns())


CONCEPTS: dict[str, Concept] = {
    "reopen": Concept(("reply", "respond", "answer"), ("reopen", "re open", "open again", "come back to this message", "activate the link", "open the link"), 12),
    "copy_link": Concept(("copy", "paste"), ("browser", "safari", "chrome"), 8),
    "reopen_han": Concept(("回复",), ("再打开", "重新打开", "再点开", "激活链接"), 10),
    "prize": Concept(("won", "winner", "prize", "prizes", "reward", "rewards", "congratulations", "voucher", "vouchers", "unclaimed", "lucky draw", "jackpot")),
    "call_number": Concept(("call", "dial", "ring", "phone", "text", "contact"), number=True, gap=6),
    "easy_money": Concept(("daily pay", "paid daily", "passive income", "guaranteed profit", "guaranteed return", "guaranteed returns", "work from home", "easy money", "high returns", "extra income", "commission", "佣金", "兼职", "刷单", "返利", "日结", "稳赚", "高回报")),
    "messenger": Concept(("whatsapp", "telegram", "wechat", "line id", "signal me", "加微信", "加qq", "微信号", "加好友", "加我", "联系老师")),
    "job": Concept(("job", "jobs", "position", "vacancy", "hiring", "recruiter", "recruiting", "recruitment", "part time", "remote work", "兼职", "招聘", "岗位", "招人")),
    "pay": Concept(("salary", "per day", "per hour", "per week", "a day", "an hour", "income", "no experience", "bonus", "日薪", "工资", "月入", "底薪")),
    "contact": Concept(("contact", "reply", "message me", "text me", "call me", "interested", "联系", "咨询", "回复")),
    "account": Concept(("account", "accounts", "card", "profile", "online banking", "wallet", "账户", "帐户", "银行卡", "账号")),
    "block": Concept(("suspended", "locked", "blocked", "restricted", "limited", "disabled", "on hold", "frozen", "deactivated", "冻结", "停用", "异常", "限制", "失效")),
    "fix": Concept(("verify", "confirm", "update", "restore", "unlock", "reactivate", "validate", "验证", "更新", "解除", "认证", "激活")),
    "utility": Concept(("electric", "electricity", "power", "gas", "water", "internet service"), ("disconnected", "disconnection", "cut off", "shut off", "switched off"), 10),
    "government": Concept(("irs", "hmrc", "tax office", "tax authority", "dmv", "treasury", "social security", "government")),
    "refund": Concept(("refund", "rebate", "stimulus", "compensation", "owed to you", "tax return", "退款", "退税", "补贴", "理赔")),
    "family": Concept(("hi mum", "hi mom", "hi dad", "hello mum", "hello mom", "hello dad", "hey mum", "hey mom", "hey dad")),
    "new_phone": Concept(("new", "lost", "broke", "broken", "dropped"), ("phone", "number", "mobile"), 6),
    "parcel": Concept(("parcel", "package", "delivery", "shipment", "courier", "usps", "fedex", "dhl", "ups", "快递", "包裹", "快件")),
    "parcel_problem": Concept(("address", "customs", "fee", "redelivery", "reschedule", "undelivered", "undeliverable", "incomplete", "held", "could not deliver", "unable to deliver", "地址", "滞留", "退回", "关税")),
    "parcel_act": Concept(("pay", "confirm", "update", "schedule", "reschedule", "track", "choose", "支付", "确认", "更新", "填写")),
    "fine": Concept(("toll", "tolls", "ezpass", "parking", "traffic", "speeding", "violation"), ("unpaid", "fine", "overdue", "penalty", "late fee", "balance", "outstanding"), 12),
    "fine_han": Concept(("罚款", "违章", "未缴费")),
    "authority": Concept(("公安", "法院", "检察院", "社保局", "医保局", "税务局")),
    "authority_lure": Concept(("逮捕", "传票", "停用", "失效", "冻结", "涉嫌", "补缴")),
    "loan": Concept(("loan", "credit line", "cash advance", "贷款", "额度", "借款", "借钱")),
    "approved": Concept(("approved", "pre approved", "preapproved", "instant", "same day", "no credit check", "已通过", "已批", "放款", "下款", "秒到")),
    "gambling": Concept(("casino", "slots", "betting", "jackpot", "free spins", "百家乐", "时时彩", "棋牌", "首充", "彩金", "投注")),
    "stock": Concept(("stock", "stocks", "shares", "trading signals", "股票", "牛股", "涨停", "荐股")),
    "group": Concept(("group", "channel", "join us", "join our", "进群", "入群", "群聊", "交流群")),
    "premium": Concept(("call", "dial", "ring"), number=True, gap=6),
    "account_lure_han": Concept(("积分", "话费", "套餐", "会员"), ("过期", "清零", "到期", "兑换"), 8),
    "flight": Concept(("flight", "航班"), ("cancelled", "canceled", "delayed", "rebook", "取消", "延误", "改签"), 10),
    "album": Concept(("photos of you", "pictures of you", "video of you", "your photos", "相册", "照片", "聚会照片")),
    "broken_lure": Concept(("免费", "领取", "贷款", "兼职", "彩金", "投注", "中奖", "返利", "刷单", "客服", "加微", "红包", "提现", "优惠", "套现", "代办", "发票", "赚钱", "福利", "充值", "注册", "下载", "链接", "点击", "秒到", "放款", "额度", "股票")),
    "mailbox": Concept(("mailbox", "inbox", "mail storage", "storage", "quota", "email account", "邮箱"), ("full", "exceeded", "limit", "expire", "expires", "expired", "upgrade", "deactivated", "suspended", "已满", "停用", "升级", "过期"), 10),
    "file_notice": Concept(("shared", "sent", "uploaded"), ("file", "files", "document", "documents", "folder", "spreadsheet"), 8),
    "file_service": Concept(("sharepoint", "onedrive", "google drive", "dropbox", "docusign", "wetransfer", "box com")),
    "subsidy": Concept(("补贴", "津贴", "补助"), ("领取", "申领", "认证", "登记"), 12),
    "warning": Concept(("beware", "scam alert", "scam warning", "never ask you", "report phishing", "fraud awareness", "谨防", "警惕", "诈骗提醒", "防骗")),
    "salutation": Concept(("dear customer", "dear user", "dear client", "dear member", "dear sir", "dear madam", "dear account holder", "dear valued customer", "尊敬的客户", "尊敬的用户")),
    "call_to_action": Concept(("click here", "click below", "click the link", "tap here", "tap the link", "follow the link", "visit the link", "open the link", "点击链接", "点此")),
    "regional": Concept(("kindly do the needful", "do the needful", "revert back", "kindly revert", "please be informed", "for your kind perusal", "good day to you")),
    "advertising": Concept(("unsubscribe", "sale", "discount", "coupon", "promo code", "limited offer", "free shipping", "退订", "促销", "优惠券", "满减", "折扣")),
    "pressure": Concept(("immediately", "within 24 hours", "urgent", "right away", "will be suspended", "will be closed", "lose access", "final notice", "立即", "马上", "冻结")),
    "dispute": Concept(("cancel", "dispute", "refund", "did not authorize", "did not authorise", "not authorized", "unrecognized", "charged", "renewed", "renewal", "subscription", "invoice")),
    "injection": Concept(("ignore", "disregard", "forget", "override"), ("previous instructions", "prior instructions", "above instructions", "all instructions", "system prompt", "your instructions"), 4),
}
