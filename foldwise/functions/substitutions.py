"""Parsing substitution lists and turning them into features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwise.functions.alphabet import AMINO_ACIDS, GAP, MASK, SCORE_FILE_ORDER

SUBSTITUTION = "struct<from_aa:string,pos:int,to_aa:string>"


def parse_substitutions(text: Column, strict: bool = True) -> Column:
    """``A123V:G124L`` as an array of (from_aa, pos, to_aa).

    Tokens that do not parse are skipped. ``strict`` wants both end letters in
    the alphabet; otherwise only the first one is checked.
    """
    last = f"[{AMINO_ACIDS}]" if strict else "."
    shape = f"^[{AMINO_ACIDS}][+-]?[0-9]+{last}$"
    tokens = F.filter(F.split(text, ":"), lambda t: t.rlike(shape))
    parsed = F.transform(
        tokens,
        lambda t: F.struct(
            F.substring(t, 1, 1).alias("from_aa"),
            t.substr(F.lit(2), F.length(t) - 2).try_cast("int").alias("pos"),
            F.substring(t, -1, 1).alias("to_aa"),
        ),
    )
    return F.filter(parsed, lambda s: s["pos"].isNotNull())


def finite(x: Column) -> Column:
    """The number as a double, NULL when it is missing, bad text, NaN or infinite."""
    d = x.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def apply_substitutions(wt: Column, subs: Column, single: Column | None = None) -> Column:
    """The reference sequence with every listed letter put in place.

    Where every letter is one byte, bytes are put in place: no characters are counted up to each place. ``single`` may carry
    ``single_bytes(wt)``, found once per reference: counting the characters of each row's reference takes longer than the rest.
    """
    plain = (single_bytes(wt) if single is None else single) & F.forall(subs, lambda x: single_bytes(x["to_aa"]) & (x["pos"] >= 1))
    as_bytes = F.aggregate(subs, wt.cast("binary"), lambda s, x: F.overlay(s, x["to_aa"].cast("binary"), x["pos"], F.lit(1)))
    return F.when(plain, as_bytes.cast("string")).otherwise(
        F.aggregate(subs, wt, lambda s, x: F.overlay(s, x["to_aa"], x["pos"], F.lit(1)))
    )


def single_bytes(text: Column) -> Column:
    """Whether every character of a text takes one byte."""
    return F.octet_length(text) == F.length(text)


def one_hot(letter: Column) -> Column:
    """Twenty indicator numbers."""
    return F.array(*[F.when(letter == F.lit(a), 1.0).otherwise(0.0) for a in AMINO_ACIDS])


def index_distance(a: Column, b: Column) -> Column:
    """Distance of two letters in the alphabet over 19; foreign letters count as the first."""
    def place(c: Column) -> Column:
        return F.greatest(F.coalesce(F.instr(F.lit(AMINO_ACIDS), c), F.lit(0)), F.lit(1))

    return F.abs(place(a) - place(b)) / F.lit(19.0)


def relabel_scores(matrix: DataFrame, matrix_order: str = "ncbi") -> DataFrame:
    """Column naming of a substitution-score table (from_aa, to_aa, score).

    ``ncbi`` keeps the names of the file. ``as_published`` gives the columns,
    taken in file order, the alphabetical names instead: the published numbers
    were computed that way.
    """
    if matrix_order == "ncbi":
        return matrix
    if matrix_order != "as_published":
        raise ValueError(f"unknown matrix order: {matrix_order}")
    return matrix.withColumn("to_aa", F.translate("to_aa", SCORE_FILE_ORDER, AMINO_ACIDS))


def with_score(rows: DataFrame, matrix: DataFrame, out: str = "score") -> DataFrame:
    """Look the substitution score up; unknown pairs score 0.

    The lookup side is reduced to one row per letter pair of the alphabet, so it
    has at most 400 rows whatever the input, which is the bound that allows the
    broadcast.
    """
    letters = list(AMINO_ACIDS)
    lookup = (
        matrix.filter(F.col("from_aa").isin(letters) & F.col("to_aa").isin(letters))
        .groupBy("from_aa", "to_aa")
        .agg(F.max(F.col("score").cast("double")).alias(out))
    )
    return rows.join(F.broadcast(lookup), ["from_aa", "to_aa"], "left").fillna(0.0, [out])


def aux_features(rows: DataFrame, matrix: DataFrame, matrix_order: str = "ncbi", out: str = "aux") -> DataFrame:
    """The 42 hand-made numbers: two one-hot letters, score, index distance."""
    scored = with_score(rows, relabel_scores(matrix, matrix_order), "_score")
    vector = F.concat(
        one_hot(F.col("from_aa")),
        one_hot(F.col("to_aa")),
        F.array(F.col("_score"), index_distance(F.col("from_aa"), F.col("to_aa"))),
    )
    return scored.withColumn(out, vector).drop("_score")


def feature_set(name: str, emb: Column, aux: Column | None = None, struct: Column | None = None) -> Column:
    """Concatenate the parts of a named feature set."""
    parts = {
        "combined": (emb, aux),
        "embedding_only": (emb,),
        "auxiliary_only": (aux,),
        "seq": (emb, aux),
        "seq_struct": (emb, struct, aux),
        "struct": (struct, aux),
    }[name]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def model_input(seq: Column, structure: Column | None = None, paired: bool = False) -> Column:
    """Space-joined model tokens of a sequence.

    ``paired`` appends to each letter its structure letter (``#`` where there is
    none), so tokens are two letters wide instead of one.
    """
    if not paired:
        return F.array_join(F.split(seq, ""), " ")
    marks = F.repeat(F.lit(GAP), F.length(seq)) if structure is None else F.rpad(structure, F.length(seq), F.lit(GAP))
    return F.array_join(F.zip_with(F.split(seq, ""), F.split(marks, ""), lambda a, b: F.concat(a, b)), " ")


def masked_input(tokens: Column, pos: Column, paired: bool = False) -> Column:
    """Model tokens with the one at a 1-based position replaced by the mask.

    All tokens are equally wide, so the text around the mask is cut out by place, by bytes where each
    character is one; the tokens themselves are built once per sequence.
    """
    width = 3 if paired else 2

    def around(text: Column, mask: Column) -> Column:
        return F.concat(F.substring(text, F.lit(1), (pos - 1) * width), mask, F.substring(text, pos * width, F.length(text)))

    as_bytes = around(tokens.cast("binary"), F.lit(MASK).cast("binary")).cast("string")
    return F.when(single_bytes(tokens), as_bytes).otherwise(around(tokens, F.lit(MASK)))
