"""Sequence, token, structure and metric files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.functions.alphabet import THREE_LETTER
from foldwise.functions.sequences import strip_insertions


def parse_fasta(records: DataFrame) -> DataFrame:
    """(file, value) records, each a header line and sequence lines: file, name, seq."""
    text = F.regexp_replace("value", "^>", "")
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x))
    body = F.array_join(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(1))), "")
    return records.select("file", F.get(lines, F.lit(0)).alias("name"), strip_insertions(body).alias("seq")).filter(
        F.length(body) > 0
    )


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Aligned sequences of many files; compressed files are read as they are.

    Records are cut by the reader at line starts with ``>``, so a large plain file
    is split over tasks.
    """
    raw = spark.read.option("lineSep", "\n>").text(path)
    return parse_fasta(raw.select(F.col("_metadata.file_path").alias("file"), "value"))


def parse_structure_tokens(files: DataFrame, refs: DataFrame) -> DataFrame:
    """Structure letters per dataset from (file, value) token files: dataset, tokens.

    A dataset's own file comes before ``query`` and ``structure`` files in a
    folder of its name. Inside a file the last line of exactly the reference
    length counts; header lines are skipped. Datasets without a match are absent.
    """
    own = F.regexp_extract("file", r"([^/]+)\.3di\.txt$", 1)
    folder = F.regexp_extract("file", r"([^/]+)/(?:query|structure)\.3di$", 1)
    first = F.when(own != "", 0).when(F.col("file").endswith("/query.3di"), 1).otherwise(2)
    named = files.select(
        F.when(own != "", own).otherwise(folder).alias("dataset"), first.alias("_rank"),
        F.transform(
            F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~x.startswith(">")),
            lambda x: F.replace(F.trim(x), F.lit(" "), F.lit("")),
        ).alias("_lines"),
    )
    fitting = named.join(refs.select("dataset", "seq_len"), "dataset").withColumn(
        "tokens", F.try_element_at(F.filter("_lines", lambda x: F.length(x) == F.col("seq_len")), F.lit(-1))
    )
    return fitting.filter(F.col("tokens").isNotNull()).groupBy("dataset").agg(F.min_by("tokens", "_rank").alias("tokens"))


def read_structure_tokens(spark: SparkSession, path: str, refs: DataFrame) -> DataFrame:
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return parse_structure_tokens(raw.select(F.col("_metadata.file_path").alias("file"), "value"), refs)


def parse_ca_residues(files: DataFrame) -> DataFrame:
    """One-letter sequence of the alpha carbons of (file, value) fixed-width structure files: file, seq."""
    names = F.create_map(*[F.lit(x) for pair in THREE_LETTER.items() for x in pair])
    atoms = F.filter(
        F.split("value", r"\r?\n"),
        lambda x: x.startswith("ATOM") & (F.trim(F.substring(x, 13, 4)) == "CA") & F.substring(x, 17, 1).isin(" ", "A"),
    )
    letters = F.transform(atoms, lambda x: F.coalesce(F.try_element_at(names, F.trim(F.substring(x, 18, 3))), F.lit("")))
    return files.select("file", F.array_join(letters, "").alias("seq"))


def read_ca_residues(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    return parse_ca_residues(raw.select(F.col("_metadata.file_path").alias("file"), "value"))


def metric_mean(table: DataFrame) -> DataFrame:
    """Mean and count of the first column whose name speaks of a rank correlation."""
    found = [c for c in table.columns if "spearman" in c.lower() or "rho" in c.lower()]
    if not found:
        raise ValueError("no correlation column")
    value = F.col(f"`{found[0]}`").try_cast("double")
    return table.agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def read_metric_mean(spark: SparkSession, path: str) -> DataFrame:
    return metric_mean(spark.read.option("header", True).option("sep", "\t").csv(path))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """A key list, one name per line."""
    return spark.read.text(path).select(F.trim("value").alias("dataset")).filter(F.length("dataset") > 0)


def read_score_matrix(spark: SparkSession, path: str) -> DataFrame:
    """A substitution-score file (comment lines, a header of letters, one row per letter): from_aa, to_aa, score.

    Such a file has some two dozen lines, so its header is looked up by the driver.
    """
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    header = lines.filter(F.col("value").rlike(r"^\s")).first()[0].split()
    cells = F.split(F.trim("value"), r"\s+")
    return lines.filter(~F.col("value").rlike(r"^\s")).select(
        F.get(cells, F.lit(0)).alias("from_aa"),
        F.posexplode(F.slice(cells, 2, len(header))).alias("_k", "_v"),
    ).select(
        "from_aa", F.get(F.array(*[F.lit(h) for h in header]), F.col("_k")).alias("to_aa"), F.col("_v").cast("double").alias("score")
    )
