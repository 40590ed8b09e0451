"""Readers of the Parquet tables, and of the corpus layouts that users bring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.functions import network as N


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events with ts as an instant; the file holds wall-clock time in UTC."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def stripped(text: Column) -> Column:
    """Without white space at the ends, line feeds included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def csv_labelled(spark: SparkSession, path: str, *, text_col: str, label_col: str, positive: str, negative: str, source: str, sep: str = ",") -> DataFrame:
    """One layout of labelled CSV as corpus rows (source, text, label); rows of other labels or without text are left out."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', sep=sep)
    label = F.when(F.col(label_col) == positive, 1).when(F.col(label_col) == negative, 0)
    return raw.select(F.lit(source).alias("source"), F.trim(F.col(text_col)).alias("text"), label.alias("label")).where("label IS NOT NULL AND text <> ''")


def csv_subject_body(spark: SparkSession, path: str, *, source: str, label_col: str = "label", min_chars: int = 20) -> DataFrame:
    """Subject, a blank line and body as text; texts of at most min_chars and mailbox control rows are left out."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    text = stripped(F.concat(F.coalesce("subject", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit(""))))
    rows = raw.select(F.lit(source).alias("source"), text.alias("text"), F.expr(f"try_cast({label_col} AS int)").alias("label"))
    control = F.col("text").rlike(r"(?i)this text is part of the internal format of your mail folder")
    return rows.where((F.length("text") > min_chars) & ~control & F.col("label").isin(0, 1))


def jsonl_records(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Valid records and rejects (line, reason): lines that do not parse into the schema or repeat an id."""
    raw = spark.read.text(path).select("value", F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    good = raw.where("r._bad IS NULL AND r IS NOT NULL").select("value", "r.*").drop("_bad")
    repeated = good.groupBy("id").count().where("count > 1").select("id")
    rejects = raw.where("r._bad IS NOT NULL OR r IS NULL").select("value", F.lit("malformed").alias("reason")).unionByName(
        good.join(repeated, "id", "left_semi").select("value", F.lit("repeated id").alias("reason"))
    )
    return good.join(repeated, "id", "left_anti").drop("value"), rejects


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def raw_mail(spark: SparkSession, path: str, max_bytes: int = 3 << 20) -> DataFrame:
    """Whole message files: path, digest of the bytes, route (message or oversized), content of messages."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = F.col("length") <= max_bytes
    return files.select("path", F.sha2("content", 256).alias("digest"), F.when(small, "message").otherwise("oversized").alias("route"), F.when(small, F.col("content")).alias("content"))


def mbox(spark: SparkSession, path: str) -> DataFrame:
    """Messages of mailbox files: path, position (in the order of reading), text. A From line after a line feed parts them, so
    a mailbox of any size is split like lines and no file stands in one row."""
    rows = spark.read.option("lineSep", "\nFrom ").text(path).select(F.input_file_name().alias("path"), F.monotonically_increasing_id().alias("position"), "value")
    return rows.select("path", "position", F.regexp_replace("value", r"^[^\n]*\n?", "").alias("text")).where("text <> ''")


def union_corpora(corpora: list[DataFrame]) -> DataFrame:
    """All corpora with source_rank, their place in the list."""
    return reduce(DataFrame.unionByName, (c.withColumn("source_rank", F.lit(i)) for i, c in enumerate(corpora)))


def registry(spark: SparkSession, path: str, key: str = "domains") -> DataFrame:
    """A JSON registry's entries (domain), lower case and distinct."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.explode(F.col(key)).alias("domain")).select(F.lower(F.trim("domain")).alias("domain")).distinct()


def catalogue(spark: SparkSession, entries: dict[str, dict]) -> DataFrame:
    """All corpora of a catalogue (name: reader, path, and the reader's options) as one, in the order of the catalogue."""
    return union_corpora([READERS[e["reader"]](spark, e["path"], source=name, **{k: v for k, v in e.items() if k not in ("reader", "path")}) for name, e in entries.items()])


def csv_json(spark: SparkSession, path: str, *, source: str, json_col: str = "email_content", label_col: str = "label", url_col: str = "url", id_col: str = "id") -> DataFrame:
    """CSV with a JSON column of subject and body: source, text, label, and a group from the digest of the link, else the id,
    else the text, so that variants of one page stay together."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"').withColumn("_j", F.from_json(json_col, "subject string, body string"))
    text = stripped(F.concat(F.coalesce("_j.subject", F.lit("")), F.lit("\n\n"), F.coalesce("_j.body", F.lit(""))))
    column = lambda c: F.col(c) if c in raw.columns else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("url:"), column(url_col)), F.concat(F.lit("id:"), column(id_col)), F.concat(F.lit("text:"), text))
    rows = raw.select(F.lit(source).alias("source"), text.alias("text"), F.col(label_col).try_cast("int").alias("label"), F.substring(F.sha2(key.cast("binary"), 256), 1, 20).alias("group"))
    return rows.where("text <> '' AND label IN (0, 1)")


def csv_dated(spark: SparkSession, path: str, *, source: str, text_col: str = "text", label_col: str = "label", date_col: str = "date", validation_from: str, holdout_from: str, sep: str = ";") -> DataFrame:
    """Dated CSV with role by date: undated rows train."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"', sep=sep)
    at = F.to_date(F.try_to_timestamp(date_col))
    role = F.when(at >= F.lit(holdout_from).cast("date"), "holdout").when(at >= F.lit(validation_from).cast("date"), "validation").otherwise("train")
    return raw.select(F.lit(source).alias("source"), F.trim(text_col).alias("text"), F.col(label_col).try_cast("int").alias("label"), at.alias("date"), role.alias("role")).where("text <> '' AND label IN (0, 1)")


def checked(rows: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that meet all rules, and the others with the first rule (by its reason) that each breaks."""
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])
    marked = rows.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def sms_jsonl(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Text-message records that keep to the label and region values and bounds, and the rejected lines with their reasons."""
    raw = spark.read.schema("label string, region string, sender string, text string, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
    rules = {"malformed": F.col("_bad").isNull(), "unknown label": F.expr("label IN ('scam', 'legitimate')"), "unknown region": F.expr("region IN ('cn', 'us')"), "sender too long": F.expr("length(coalesce(sender, '')) <= 64"), "text length": F.expr("length(text) BETWEEN 1 AND 2000")}
    good, bad = checked(raw, rules)
    return good.drop("_bad"), bad.select("label", "region", "sender", "text", "reason")


def private_jsonl(spark: SparkSession, path: str, schema: str, *, with_digest: bool = False) -> DataFrame:
    """Records, with the SHA-256 of each line's bytes if asked for."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    rows = lines.select(F.from_json("value", schema).alias("r"), F.sha2(F.col("value").cast("binary"), 256).alias("line_sha256"))
    return rows.select("r.*", "line_sha256") if with_digest else rows.select("r.*")


def seeds_and_variants(records: DataFrame, *, id_col: str, seed_col: str, source_col: str, manual: str) -> tuple[DataFrame, DataFrame]:
    """Records of the manual source, and variants whose seed is one of them."""
    seeds = records.where(F.col(source_col) == manual)
    wanted = seeds.select(F.col(id_col).alias("_seed")).distinct()
    return seeds, records.where(F.col(source_col) != manual).join(wanted, F.col(seed_col) == F.col("_seed"), "left_semi")


BRAND = "name string, aliases array<string>, domains array<string>, sites array<string>, region string, senders array<string>"


def brands(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Six views of one registry of brands: official domains, names, aliases, labels of their sites, regions and senders."""
    rows = spark.read.schema(BRAND).json(path, multiLine=True).withColumn("name", F.lower("name"))
    each = lambda c, out: rows.select("name", F.explode(c).alias("_x")).select("name", F.lower("_x").alias(out)).distinct()
    return {
        "domains": each("domains", "domain"), "names": rows.select("name").distinct(), "aliases": each("aliases", "alias"),
        "site_labels": each("sites", "site").select("name", F.element_at(F.split("site", r"\."), 1).alias("label")).distinct(), "regions": rows.select("name", "region").distinct(), "senders": each("senders", "sender"),
    }


def ip_lists(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(address, value) of single addresses, and (start, end, listing) of networks in prefix notation, as numbers."""
    raw = spark.read.schema("tor_exits struct<addresses:array<string>>, spamhaus_drop struct<networks:array<array<string>>>").json(path, multiLine=True)
    single = raw.select(F.explode("tor_exits.addresses").alias("address")).select("address", N.ipv4_number(F.col("address")).alias("value")).where("value IS NOT NULL").distinct()
    nets = raw.select(F.explode("spamhaus_drop.networks").alias("n")).select(F.get("n", F.lit(0)).alias("cidr"), F.get("n", F.lit(1)).alias("listing"))
    size = F.pow(F.lit(2.0), 32 - F.regexp_extract("cidr", r"/(\d+)$", 1).try_cast("int")).cast("long")
    start = N.ipv4_number(F.substring_index("cidr", "/", 1))
    ranges = nets.select((start - start % size).alias("start"), size.alias("_size"), "listing").where("start IS NOT NULL AND _size IS NOT NULL")
    return single, ranges.select("start", (F.col("start") + F.col("_size") - 1).alias("end"), "listing")


def tabular(spark: SparkSession, path: str | None, columns: list[str], *, rows: int = 11_055, seed: int = 42) -> DataFrame:
    """Feature columns of -1, 0 and 1 and label from CSV (result: -1 or 1); without a path the same shape made up, the label
    leaning on the first features."""
    if path:
        raw = spark.read.csv(path, header=True)
        return raw.select(*[F.coalesce(F.col(c).try_cast("int"), F.lit(0)).alias(c) for c in columns], F.when(F.col("result").try_cast("int") == -1, 0).otherwise(1).alias("label"))
    made = spark.range(rows).select(*[(F.floor(F.rand(seed + i) * 3) - 1).cast("int").alias(c) for i, c in enumerate(columns)])
    lean = sum((F.col(c) for c in columns[:3]), F.lit(0))
    return made.withColumn("label", (lean + F.randn(seed - 1) > 0).cast("int"))


def routed(mail: DataFrame, *, since: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Files of raw_mail with why each is left out (repeated, oversized, too old), null for those that stay, and the counts by
    reason. Of equal files the one of the least path stays."""
    first = mail.groupBy("digest").agg(F.min("path").alias("_first"))
    rows = mail.join(first, "digest")
    old = F.coalesce(since, F.lit(False)) if since is not None else F.lit(False)
    rows = rows.withColumn("reason", F.when(F.col("path") != F.col("_first"), "repeated").when(F.col("route") != "message", "oversized").when(old, "too old")).drop("_first")
    return rows, rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


#: Readers that a catalogue may name.
READERS = {"csv_labelled": csv_labelled, "csv_subject_body": csv_subject_body}
