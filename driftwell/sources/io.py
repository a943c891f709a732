"""Readers and writers: fixed schemas, strict parsing, integrity checks, committed outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftwell.functions import vectors as V
from driftwell.operators.quality import duplicated, require_none

ANSWER = "struct<answer:string,is_correct:boolean,behavior:string,applicability:string,error_type:string>"
#: A ticket record.
TICKET = f"""id string, quarter string, sequence_in_quarter int, shuffled_order int, difficulty string, category string, policy_key string,
  article_title string, question string, gold_answer string,
  profile_answers struct<ceo:{ANSWER},domain_expert_out_of_domain:{ANSWER},intern:{ANSWER}>,
  documentation_anchor string, is_changed_answer_near_duplicate boolean, near_duplicate_of string, similar_question_ids array<string>,
  drift struct<type:string,change_kind:string,change_dimensions:array<string>,introduced_in:string,previous_rule:string,current_rule:string,
    previous_gold_answer:string,current_gold_answer:string,changed_article:string>,
  requires_model_abstention boolean"""
#: Periods in order; Extra comes last and is optional.
QUARTERS = ("Q1", "Q2", "Q3", "Q4", "Extra")
#: The ranges of a ticket's fields.
DIFFICULTIES, CATEGORIES = ("easy", "normal", "hard"), ("billing", "integrations", "permissions", "reporting", "onboarding")


def quarter_rank(c: Column) -> Column:
    """Place of a quarter name, from 1; null for other names."""
    return F.element_at(F.create_map(*[F.lit(x) for i, q in enumerate(QUARTERS, 1) for x in (q, i)]), c)


def read_tickets(spark: SparkSession, files: dict[str, str], include_extra: bool = True) -> DataFrame:
    """Tickets of a manifest's files (quarter -> path); files of quarters that are not wanted are not opened."""
    wanted = {q: p for q, p in files.items() if include_extra or q != "Extra"}
    unknown = set(wanted) - set(QUARTERS)
    if unknown or not wanted:
        raise ValueError(f"quarters {sorted(unknown)}" if unknown else "no quarter to read")
    rows = None
    for q in sorted(wanted, key=QUARTERS.index):
        part = spark.read.schema(TICKET).option("mode", "FAILFAST").option("multiLine", True).json(wanted[q]).withColumn("_of", F.lit(q))
        rows = part if rows is None else rows.unionByName(part)
    return rows


def ticket_violations(rows: DataFrame) -> dict[str, DataFrame]:
    """Offending rows by rule, for ``quality.violations``."""
    return {
        "ids are unique": duplicated(rows, "id"),
        "quarters are known": rows.filter(quarter_rank(F.col("quarter")).isNull()),
        "files hold their own quarter": rows.filter(F.col("quarter") != F.col("_of")) if "_of" in rows.columns else rows.limit(0),
        "difficulties are known": rows.filter(~F.col("difficulty").isin(*DIFFICULTIES)),
        "categories are known": rows.filter(~F.col("category").isin(*CATEGORIES)),
        "places lie in 1..500": rows.filter("not sequence_in_quarter between 1 and 500"),
        "drifted tickets name their source": rows.filter("is_changed_answer_near_duplicate and near_duplicate_of is null"),
    }


def read_embeddings(spark: SparkSession, path: str, key: str = "id", vector: str = "embedding") -> DataFrame:
    """``(id, v)`` with unit vectors; fails on repeated ids and on vectors without a direction."""
    rows = spark.read.parquet(path).select(F.col(key).alias("id"), V.normalised(F.col(vector)).alias("v"))
    require_none(duplicated(rows, "id"), "embedding ids repeat")
    require_none(rows.filter("v is null"), "an embedding is zero or not finite")
    return rows


def attach_embeddings(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """Each row's vector by id; a row without one is an error."""
    right = vectors.select(F.col("id").alias("_id"), "v")
    joined = rows.join(right, F.col("id") == F.col("_id"), "left")
    sure = F.when(F.col("_id").isNull(), F.raise_error(F.concat(F.lit("no embedding for "), F.col("id").cast("string"))).cast("array<double>")).otherwise(F.col("v"))
    return joined.withColumn("v", sure).drop("_id")


def request_violations(request: DataFrame, canonical: DataFrame, embedded: DataFrame) -> DataFrame:
    """``(id, reason)`` of requested tickets that are not the benchmark's: unknown id, other question, or none embedded."""
    known = canonical.select(F.col("id").alias("_c"), F.col("question").alias("_cq"))
    source = embedded.select(F.col("id").alias("_e"), F.col("question").alias("_eq"))
    both = request.select("id", "question").join(known, F.col("id") == F.col("_c"), "left").join(source, F.col("id") == F.col("_e"), "left")
    reason = (
        F.when(F.col("_c").isNull(), "not part of the benchmark")
        .when(~F.col("question").eqNullSafe(F.col("_cq")), "question differs from the benchmark")
        .when(F.col("_e").isNull(), "no embedded question")
        .when(~F.col("question").eqNullSafe(F.col("_eq")), "question differs from the embedded one")
    )
    return both.select("id", reason.alias("reason")).filter("reason is not null")


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length, sha256)`` of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def checksum_failures(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Manifest rows ``(name, sha256)`` whose file is missing or has another digest."""
    found = file_digests(spark, path).select(F.element_at(F.split("path", "/"), -1).alias("_name"), F.col("sha256").alias("_sha"))
    return manifest.join(found, F.col("name") == F.col("_name"), "left").filter("_sha is null or _sha <> sha256").select("name", "sha256", F.col("_sha").alias("found"))


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines, strictly; blank lines are skipped."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("_r"))
    return parsed.select("_r.*")


def bad_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``(file, line, value)`` of lines that do not parse; numbers count every line of each file, from 1.

    A file is read in as many splits as it has.  A line's number is its place in its split and the lines of the splits
    before it, which is one count a split.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at")]
    # Ids grow along a partition, and a partition reads its splits one after the other, each from its start.
    lines = spark.read.option("lineSep", "\n").text(path).select(*split, F.monotonically_increasing_id().alias("_id"), "value")
    counts = lines.groupBy("file", "_at").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(F.col("file").alias("_f"), F.col("_at").alias("_s"), "_first", F.coalesce(before, F.lit(0)).alias("_before"))
    broken = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})["_corrupt"]
    bad = lines.filter((F.trim("value") != "") & broken.isNotNull())
    found = bad.join(starts, (F.col("file") == F.col("_f")) & (F.col("_at") == F.col("_s")))
    return found.select("file", (F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("line"), "value")


def read_runs(spark: SparkSession, path: str, schema: str, expected: int) -> DataFrame:
    """Finished runs ``run-*.json`` with their number; fails unless runs 1..expected are all there."""
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{path}/run-*.json")
    number = F.regexp_extract(F.input_file_name(), r"run-(\d+)\.json", 1).cast("int")
    rows = rows.withColumn("run", number)
    found = {r.run for r in rows.select("run").distinct().collect()}  # at most one row a file
    if found != set(range(1, expected + 1)):
        raise ValueError(f"runs {sorted(set(range(1, expected + 1)) - found)} are missing")
    return rows


def gold_answers(shared: DataFrame, variant: DataFrame) -> DataFrame:
    """``(id, gold_answer)``: the variant's answer where it has one, else the shared one."""
    both = shared.select("id", "gold_answer", F.lit(0).alias("_p")).unionByName(variant.select("id", "gold_answer", F.lit(1).alias("_p")))
    return both.groupBy("id").agg(F.max_by("gold_answer", "_p").alias("gold_answer"))


def append_batch(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_csv(rows: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns in this order; what a table lacks is empty."""
    rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in columns]).write.mode("errorifexists").option("header", True).option("nullValue", "").csv(path)


def write_gzip_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("compression", "gzip").json(path)


def write_memory(rows: DataFrame, path: str, files: int = 64) -> None:
    """A memory table ranged by insertion index, so age windows skip files by their statistics."""
    rows.repartitionByRange(files, "ins").sortWithinPartitions("ins").write.mode("errorifexists").parquet(path)


def latex_table(rows: DataFrame, most: int = 200) -> str:
    """A small result as a LaTeX table; over ``most`` rows is an error."""
    data = rows.limit(most + 1).collect()
    if len(data) > most:
        raise ValueError(f"over {most} rows")

    def show(x) -> str:
        return "--" if x is None else f"{x:.3f}" if isinstance(x, float) else str(x).replace("_", r"\_").replace("%", r"\%").replace("&", r"\&")

    head = " & ".join(show(c) for c in rows.columns)
    body = "\n".join(" & ".join(map(show, r)) + r" \\" for r in data)
    return f"\\begin{{tabular}}{{{'l' * len(rows.columns)}}}\n\\toprule\n{head} \\\\\n\\midrule\n{body}\n\\bottomrule\n\\end{{tabular}}\n"


def documentation(articles: DataFrame, by: str) -> DataFrame:
    """One markdown text per group of ``(key, title, rule, owner)``, articles in key order."""
    part = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), F.col("rule"), F.lit("\n\nOwner: "), F.coalesce("owner", F.lit("none")), F.lit("\n"))
    rows = articles.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("key", part.alias("t")))).alias("_a"))
    return rows.select(by, F.array_join(F.transform("_a", lambda x: x["t"]), "\n").alias("markdown"))
