"""Parsers of markup, messages, documents, requests and links on hand-made inputs."""

import io
import zipfile
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from riskloom.functions import policy as P
from riskloom.operators import html as H
from riskloom.operators import links as K
from riskloom.operators import mail
from riskloom.operators import requests as Q
from riskloom.operators import sender
from riskloom.sources import tables


def test_html_shows_what_is_visible():
    page = """<style>.x{display:none} #y, p.z {visibility:hidden}</style><p>Hello <b>there</b></p><div class=x>secret</div><span style="font-size:0px">tiny</span>
    <a href="https://a.example/x">click <i>me</i></a><img src="data:x"><img src="https://i.example/p"><form><input type=password></form><span style="color:#fff;background:#fff">white</span><script>no()</script>"""
    out = H.read(page)
    assert out["visible"].split() == "Hello there click me".split()
    assert out["links"] == [{"label": "click me", "destination": "https://a.example/x"}]
    assert (out["data_images"], out["remote_images"], out["password_form"], out["uncertain"]) == (1, 1, True, True)
    assert out["hidden_chars"] == len("secrettinywhite")
    assert H.read(None)["visible"] == ""


def as_its_sql(spark, tmp_path, name, pages):
    """Whether a query over pages gives its SQL's rows."""
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    out = con.sql(entry.oracle_sql()[name])
    order = [out.columns.index(c) for c in df.columns]
    return sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in order) for r in out.fetchall())


#: Headings that end inside a character reference, which the table's pages hold where a title was cut to its length.
CUT = [f"<html><head><title>t</title></head><body><h1>a {x}</h1><p>b &amp; c</p></body></html>" for x in ("&amp", "&am", "&", "&quot", "&&amp;amp", "&amp;")]


def test_html_query_keeps_open_references_as_its_sql_does(spark, tmp_path):
    assert as_its_sql(spark, tmp_path, "html_visible_text", CUT)


def test_message_query_keeps_open_references_as_its_sql_does(spark, tmp_path):
    assert as_its_sql(spark, tmp_path, "message_parse", CUT)


def test_open_references():
    page = "<p>a &amp b &copy &lt;i &#65; &#x42; &bogus; &#66 &</p><a href='?x=1&amp=2'>l</a>"
    assert H.read(page)["visible"] == "a & b © <i A B &bogus; B &\nl"
    assert H.read(page, open_references=False)["visible"] == "a &amp b &copy <i A B &bogus; &#66 &\nl"


def test_mail_flattens_nested_messages(spark):
    inner = b"From: c@x.example\r\nSubject: inner\r\n\r\nInner body"
    raw = (
        b"From: A <a@x.example>\r\nReply-To: r@y.example\r\nSubject: =?utf-8?q?h=C3=A9?=\r\nReceived: one\r\nReceived: two\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=B\r\n\r\n"
        b"--B\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nOuter body\r\n--B\r\nContent-Type: text/html\r\n\r\n<p>Hi <a href='http://z.example'>z</a></p>\r\n--B\r\nContent-Type: message/rfc822\r\n\r\n" + inner + b"\r\n--B--\r\n"
    )
    df = spark.createDataFrame([(1, bytearray(raw)), (2, None)], "id int, raw binary")
    rows = {(r.id, r.node): r for r in mail.messages(df, id_col="id", raw_col="raw").collect()}
    top, sub = rows[(1, 0)], rows[(1, 1)]
    assert (top.subject, top.reply_to, top.received, top.plain.strip(), top.html_text) == ("hé", "r@y.example", ["one", "two"], "Outer body", "Hi z")
    assert (sub.parent, sub.depth, sub.subject, sub.plain.strip()) == (0, 1, "inner", "Inner body")
    assert rows[(2, 0)].plain == "" and not top.incomplete


def test_documents():
    stream = zlib.compress(b"BT /F1 12 Tf (Hello \\(you\\)) Tj 0 -14 Td <48 69> Tj ET")
    data = b"%PDF-1.4 /A << /URI (https://p.example/a) >> stream\n" + stream + b"\nendstream"
    assert mail.pdf(data) == ("Hello (you)\nHi", ["https://p.example/a"], "ok")
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{mail.W[1:-1]}"><w:p><w:t>One</w:t><w:t> two</w:t></w:p></w:document>')
        z.writestr("word/_rels/document.xml.rels", '<R><r Target="https://d.example"/><r Target="x.xml"/></R>')
    assert mail.docx(buffer.getvalue()) == ("One two", ["https://d.example"], "ok")
    assert mail.docx(b"junk")[2] == "unreadable"


def test_authentication_results():
    out = mail.authentication('mx.example; spf=pass (a (b) c; x) smtp.mailfrom=a@x.example; dkim=fail header.d="y.example"; dmarc=none')
    assert out == {"spf": "pass", "smtp.mailfrom": "a@x.example", "dkim": "fail", "header.d": "y.example", "dmarc": "none"}


def test_authentication_is_read_where_clauses_begin():
    assert mail.authentication('mx.example; dkim=fail reason="dmarc=pass spf=pass"; dmarc=fail') == {"dkim": "fail", "dmarc": "fail"}
    assert mail.authentication('mx; spf=fail reason="a \\"; spf=pass"; spf=pass') == {"spf": "fail"}
    assert mail.authentication('mx; dkim=pass (spf=pass; dmarc=pass) header.d=a.example') == {"dkim": "pass", "header.d": "a.example"}
    assert mail.authentication('mx; note spf=pass') == {} and mail.authentication('mx; spf=pass reason="open') == {} and mail.authentication(None) == {}
    assert mail.header_readings({"From": ["a", "b"], "To": ["c"], "Cc": []}) == [{"From": "a", "To": "c"}, {"From": "b", "To": "c"}]
    assert len(mail.header_readings({k: list("123456789") for k in "abc"})) == 32


def test_markup_without_end_tags():
    assert H.read('<p style="display:none">secret<p>Pay now<p>Second')["visible"] == "Pay now\nSecond"
    assert H.read("<ul><li hidden>one<li>two<ul><li>inner</ul><li>three</ul>")["visible"] == "two\ninner\nthree"
    assert H.read("<table><tr><td hidden>a<td>b<tr><td>c</table>after")["visible"] == "b\nc\nafter"
    assert H.read('<dl><dt hidden>x<dd>y</dl><div style="display:none"><p>no</div><p>yes</div>z')["visible"] == "y\nyes\nz"
    assert H.read('<p style="color:#fff;background:white">a</p><p style="color:#777;background:#fff">b</p><p style="font-size:0.5pt">c</p><p style="position:absolute;left:-9999px">d</p>')["visible"] == "b"
    assert H.contrast("black", "#fff") == pytest.approx(21) and H.contrast("a", "b") is None and H.pixels("1in") == 96 and H.pixels("50%") is None and H.pixels("0") == 0


REQUESTS = [
    ("Please text me the security code we sent", ["one_time_code"]), ("Staff will never ask you to tell them your passcode", []), ("No need to panic. Reply with the login code", ["one_time_code"]),
    ("Type your card PIN", ["password_pin"]), ("请勿告知他人。给客服验证码", ["one_time_code"]), ("回复验证码即可", ["one_time_code"]), ("不要提供验证码", []), ("open RustDesk and shift the money to a secure wallet", ["crypto_transfer", "remote_access"]),
    ("Do not share your password, but send me your pin", ["password_pin"]), ("buy gift cards to clear the debt", ["gift_card"]), ("buy gift cards for her wedding", []), (None, []), ("", []),
]


def test_requests(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(REQUESTS)], "id int, text string")
    out = {r.id: r.codes for r in Q.sensitive_requests(rows, id_cols=["id"], text_col="text").collect()}
    assert out == {i: codes for i, (_, codes) in enumerate(REQUESTS)}


def test_link_rules(spark):
    rows = [
        (1, "pay.example.com", "https://evil.example.net/login"), (2, "", "hxxp://x.example"), (3, "", "javascript:alert(1)"), (4, "", "https://u:p@h.example/"), (5, "", "http://10.1.2.3/a"),
        (6, "", "https://acrne.example/"), (7, "", "https://acme-help.vercel.app"), (8, "", "https://shop.acme.example/"), (9, "", "https://bad host/"), (10, "", "mailto:a@b.example"), (11, None, None),
    ]
    df = spark.createDataFrame(rows, "id int, label string, destination string")
    out = {r.id: set(r.found) for r in K.findings(df, {"acme": ("acme.example",)}).collect()}
    assert out == {1: {"display_mismatch", "sensitive_host"} - {"sensitive_host"}, 2: {"obfuscated_scheme"}, 3: {"unsafe_scheme"}, 4: {"url_userinfo"}, 5: {"ip_host"}, 6: {"brand_lookalike"}, 7: {"dev_hosting", "brand_on_free_host"}, 8: set(), 9: {"malformed_target"}, 10: set(), 11: set()}
    text = spark.createDataFrame([("see [here](https://a.example/x) and http://b.example/y.",)], "t string").select(K.in_text(F.col("t"))).first()[0]
    assert [tuple(x) for x in text] == [("here", "https://a.example/x"), ("http://b.example/y", "http://b.example/y")]


def test_policies(spark):
    df = spark.createDataFrame([(["v=spf1 a -all"],), (["v=spf1 -all", "v=spf1 a"],), ([],)], "r array<string>")
    assert [r[0] for r in df.select(P.spf(F.col("r"))).collect()] == ["strict", "error", "missing"]
    df = spark.createDataFrame([(["v=DMARC1; p=none; pct=101"],), (["v=DMARC1; p=quarantine"],)], "r array<string>")
    assert [tuple(r[0]) for r in df.select(P.dmarc(F.col("r"))).collect()] == [("error", None, None), ("ok", "quarantine", 100)]


def test_sender_features(spark):
    rows = ["jane.doe@gmail.com", "x9k2j4qz8w@secure-login.tk", "a@1.2.3.4", "info@paypa1.com", "help@paypal.com", "no at", "12345678@qq.com"]
    out = {r.address: r for r in sender.features(spark.createDataFrame([(a,) for a in rows], "address string")).collect()}
    assert out["jane.doe@gmail.com"].band == "low" and not out["jane.doe@gmail.com"].random_username and out["jane.doe@gmail.com"].n_high == 0
    bad = out["x9k2j4qz8w@secure-login.tk"]
    assert (bad.statistical_report, bad.prefix_suffix, bad.page_rank, bad.on_mouseover, bad.port) == (-1, -1, -1, -1, -1) and bad.random_username and bad.band == "critical"
    assert out["a@1.2.3.4"].having_ip_address == -1 and out["a@1.2.3.4"].having_sub_domain == 1
    assert out["info@paypa1.com"].links_in_tags == -1 and out["info@paypa1.com"].score >= 60 and out["help@paypal.com"].links_in_tags == 1
    assert out["no at"].links_pointing_to_page == -1 and not out["12345678@qq.com"].random_username
    features = [c for c in out["a@1.2.3.4"].asDict() if c not in ("address", "n_high", "n_medium", "n_low", "score", "random_username", "band")]
    assert len(features) == 30


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('subject,body,label\nHi,"a long enough body, with comma",1\n,short,0\nx,"another body that is long enough",7\n')
    assert [(r.label, r.text) for r in tables.csv_subject_body(spark, str(tmp_path / "a.csv"), source="s").collect()] == [(1, "Hi\n\na long enough body, with comma")]
    (tmp_path / "b.jsonl").write_text('{"id":"1","t":"x"}\n{"id":"2"}\nnot json\n{"id":"2"}\n')
    good, bad = tables.jsonl_records(spark, str(tmp_path / "b.jsonl"), "id string, t string")
    assert [r.id for r in good.collect()] == ["1"] and sorted(r.reason for r in bad.collect()) == ["malformed", "repeated id", "repeated id"]
    (tmp_path / "c.mbox").write_text("From a@x Mon\nSubject: 1\n\nbody\nFrom b@x Tue\nSubject: 2\n\nbody\n")
    assert tables.mbox(spark, str(tmp_path / "c.mbox")).count() == 2
    (tmp_path / "r.json").write_text('{"domains": ["A.example", "b.example", "a.example "]}')
    assert sorted(r.domain for r in tables.registry(spark, str(tmp_path / "r.json")).collect()) == ["a.example", "b.example"]
    both = tables.union_corpora([spark.range(2).select(F.col("id")), spark.range(1).select(F.col("id"))])
    assert sorted(r.source_rank for r in both.collect()) == [0, 0, 1]


def test_more_sources(spark, tmp_path):
    (tmp_path / "j.csv").write_text('email_content,label,url,id\n"{""subject"":""S"",""body"":""B""}",1,http://a,1\n"{""body"":""C""}",0,,2\nbad,1,,3\n')
    rows = tables.csv_json(spark, str(tmp_path / "j.csv"), source="s").collect()
    assert sorted((r.text, r.label) for r in rows) == [("C", 0), ("S\n\nB", 1)] and len({r.group for r in rows}) == 2
    (tmp_path / "d.csv").write_text("text;label;date\na;1;2023-05-01\nb;0;2024-05-01\nc;1;2025-05-01\nd;0;\n")
    assert {r.text: r.role for r in tables.csv_dated(spark, str(tmp_path / "d.csv"), source="s", validation_from="2024-01-01", holdout_from="2025-01-01").collect()} == {"a": "train", "b": "validation", "c": "holdout", "d": "train"}
    (tmp_path / "s.jsonl").write_text('{"label":"scam","region":"us","sender":"1","text":"x"}\n{"label":"odd","region":"us","text":"x"}\n{"label":"scam","region":"xx","text":"x"}\n{"label":"scam","region":"cn","text":""}\nno\n')
    good, bad = tables.sms_jsonl(spark, str(tmp_path / "s.jsonl"))
    assert good.count() == 1 and sorted(r.reason for r in bad.collect()) == ["malformed", "text length", "unknown label", "unknown region"]
    private = tables.private_jsonl(spark, str(tmp_path / "s.jsonl"), "label string, text string", with_digest=True).collect()
    assert len(private) == 5 and all(len(r.line_sha256) == 64 for r in private)
    records = spark.createDataFrame([("1", None, "manual"), ("2", None, "other"), ("3", "1", "made"), ("4", "2", "made")], "id string, seed string, source string")
    seeds, variants = tables.seeds_and_variants(records, id_col="id", seed_col="seed", source_col="source", manual="manual")
    assert [r.id for r in seeds.collect()] == ["1"] and [r.id for r in variants.collect()] == ["3"]
    (tmp_path / "b.json").write_text('[{"name":"Acme","aliases":["AC"],"domains":["Acme.example"],"sites":["shop.acme.example"],"region":"cn","senders":["95588"]}]')
    views = {k: [tuple(r) for r in v.collect()] for k, v in tables.brands(spark, str(tmp_path / "b.json")).items()}
    assert views == {"domains": [("acme", "acme.example")], "names": [("acme",)], "aliases": [("acme", "ac")], "site_labels": [("acme", "shop")], "regions": [("acme", "cn")], "senders": [("acme", "95588")]}
    (tmp_path / "i.json").write_text('{"tor_exits":{"addresses":["1.2.3.4","x"]},"spamhaus_drop":{"networks":[["10.0.1.7/24","SBL1"],["bad","SBL2"]]}}')
    single, ranges = tables.ip_lists(spark, str(tmp_path / "i.json"))
    assert [tuple(r) for r in single.collect()] == [("1.2.3.4", 16909060)] and [tuple(r) for r in ranges.collect()] == [(167772416, 167772671, "SBL1")]
    made = tables.tabular(spark, None, ["a", "b", "c", "d"], rows=500)
    assert made.count() == 500 and {r.a for r in made.collect()} == {-1, 0, 1} and made.agg({"label": "sum"}).first()[0] > 50
    (tmp_path / "t.csv").write_text("a,b,result\n1,x,-1\n-1,0,1\n")
    assert sorted(tuple(r) for r in tables.tabular(spark, str(tmp_path / "t.csv"), ["a", "b"]).collect()) == [(-1, 0, 1), (1, 0, 0)]
    for i, text in enumerate(("m", "m", "n" * 50)):
        (tmp_path / "mail").mkdir(exist_ok=True)
        (tmp_path / "mail" / f"{i}.eml").write_text(text)
    rows, counts = tables.routed(tables.raw_mail(spark, str(tmp_path / "mail"), max_bytes=10))
    assert {r.reason: r.n for r in counts.collect()} == {"kept": 1, "repeated": 1, "oversized": 1} and rows.count() == 3
    (tmp_path / "l.csv").write_text("t,k\nhello,Safe\nbye,Bad\n")
    both = tables.catalogue(spark, {"one": {"reader": "csv_labelled", "path": str(tmp_path / "l.csv"), "text_col": "t", "label_col": "k", "positive": "Bad", "negative": "Safe"}})
    assert sorted((r.source, r.text, r.label) for r in both.collect()) == [("one", "bye", 1), ("one", "hello", 0)]


def test_links_as_a_table_function_and_model_views(spark):
    H.register(spark)
    spark.createDataFrame([(1, '<a href="http://a.example/">x <b>y</b></a>'), (2, "")], "id int, html string").createOrReplaceTempView("pages_of_links")
    assert [tuple(r) for r in spark.sql("SELECT id, l.label, l.destination FROM pages_of_links, LATERAL extract_links(html) l").collect()] == [(1, "x y", "http://a.example/")]
    df = spark.createDataFrame([("S", ["a", " a ", ""], ["v"]), ("only", None, None)], "s string, p array<string>, v array<string>")
    assert [r[0] for r in df.select(H.model_views(F.col("p"), F.col("v"), F.col("s"))).collect()] == [["S\n\na", "S\n\nv"], ["only"]]
    assert [r[0] for r in spark.createDataFrame([(1, "short"), (1, "x" * 90), (0, "")], "n int, t string").select(H.image_dominant(F.col("n"), F.col("t"))).collect()] == [True, False, False]


def test_conjunction_rules(spark):
    from riskloom.operators import conjunctions as C

    rows = [
        (1, "Congratulations, you won! Call 0900 123 456 now"), (2, "Your account is locked, verify at http://x.example/a"), (3, "Beware: scams say your account is locked, verify at http://x.example"),
        (4, "兼.职日结，加微信 abc"), (5, "Remote job, $300 per day, apply bit.ly http://bit.ly/x"), (6, "lunch at noon?"), (7, None), (8, "Your account is locked, verify at http://a.own.example/a"),
    ]
    df = spark.createDataFrame(rows, "id int, text string")
    out = C.evaluate(df, C.SMS, text_col="text", own_domains=F.array(F.lit("own.example"))).select("id", F.transform("found", lambda x: x["code"]).alias("codes"), C.verdict(F.col("found")).alias("v"))
    got = {r.id: (r.codes, r.v) for r in out.collect()}
    assert got[1] == (["sms.prize_callback", "sms.premium_callback"], "medium") and got[2] == (["sms.account_threat"], "medium") and got[3] == ([], "unknown")
    assert got[4][0] == ["sms.external_contact_lure"] and got[5][0] == ["sms.job_offer"] and got[6] == got[7] == got[8] == ([], "unknown")
    kinds = spark.createDataFrame([("+86 138 0013 8000",), ("10690012345",), ("95588",), ("+1 (800) 555-0100",), ("212-555-0100",), ("BANK",), ("a@b.example",), ("",), ("1",)], "s string")
    assert [r[0] for r in kinds.select(C.sender_kind(F.col("s"))).collect()] == ["cn_mobile", "cn_port_106", "short_code", "nanp_toll_free", "nanp_long_code", "alphanumeric", "email", "none", "other"]
