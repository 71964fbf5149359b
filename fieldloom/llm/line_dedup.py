"""Recurring lines across documents by a log-template tree of fixed depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.llm.common import bit_table, put_back, set_aside, with_hit
from fieldloom.session import stored

WILD = "<*>"


def masked(line: Column) -> Column:
    """Words with a digit are variable fields."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, r"[^ ]*[0-9][^ ]*", WILD)).otherwise(line)


def _lines(text: Column) -> Column:
    """Lines of a text, their words (parted by spaces, tabs, carriage returns) joined by one space."""
    odd = text.contains("  ") | text.contains("\t") | text.contains("\r")
    text = F.when(odd, F.regexp_replace(text, r"[ \t\r]+", " ")).otherwise(text)
    text = F.replace(F.replace(text, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return F.split(F.trim(text), "\n")


def placed_lines(docs: DataFrame, depth: int, min_tokens: int, text_col: str) -> DataFrame:
    """``_no, _line, _leaf`` for every line of ``min_tokens`` words or more, with the columns of
    ``docs`` but the text. The leaf is the place in the tree: the number of words, then the first
    ``depth`` words."""
    keep = [c for c in docs.columns if c != text_col]
    lines = docs.select(*keep, F.posexplode(_lines(F.col(text_col))).alias("_no", "_line"))
    words = F.octet_length("_line") - F.octet_length(F.replace("_line", F.lit(" "), F.lit(""))) + 1
    lead = masked(F.substring_index("_line", " ", depth))
    return lines.filter(words >= min_tokens).select(*keep, "_no", "_line", F.concat_ws(" ", words.cast("string"), lead).alias("_leaf"))


def _patterns(each: DataFrame, depth: int, constant_share: float, similarity: float) -> DataFrame:
    """For each leaf of several lines: at which places a word is constant (``_pattern``), or null
    where too few places behind the leading words are (these are constant in every leaf)."""
    several = each.groupBy("_leaf").agg(F.count("*").alias("_lines")).filter("_lines > 1")
    words = each.join(several.select("_leaf"), "_leaf").select("_leaf", F.posexplode(F.split("_masked", " ")).alias("_at", "_word"))
    tops = words.groupBy("_leaf", "_at", "_word").agg(F.count("*").alias("_n")).groupBy("_leaf", "_at").agg(F.max("_n").alias("_top"))
    fixed = tops.join(several, "_leaf").select("_leaf", "_at", (F.col("_top") >= constant_share * F.col("_lines")).alias("_fixed"))
    by_leaf = fixed.groupBy("_leaf").agg(
        F.sort_array(F.collect_list(F.struct("_at", "_fixed"))).getField("_fixed").alias("_pattern"),
        F.avg(F.when(F.col("_at") >= depth, F.col("_fixed").cast("int"))).alias("_share"))
    return by_leaf.select("_leaf", F.when(F.col("_share") >= similarity, F.col("_pattern")).alias("_pattern"))


def _recurring(each: DataFrame, depth: int, constant_share: float, similarity: float) -> DataFrame:
    """Rows (_leaf, _key, _keeper): lines whose template two documents have, with the smallest id."""
    wild = F.array_join(F.zip_with(F.split("_masked", " "), "_pattern", lambda w, fixed: F.when(fixed, w).otherwise(WILD)), " ")
    template = F.when(F.col("_pattern").isNull(), F.col("_masked")).otherwise(wild)
    placed = each.join(_patterns(each, depth, constant_share, similarity), "_leaf", "left").select(
        "_leaf", "_key", F.unhex(F.md5(template)).alias("_template"), "_a", "_b")
    found = placed.groupBy("_leaf", "_template").agg(F.min("_a").alias("_keeper"), F.max("_b").alias("_z")).filter("_keeper < _z")
    return placed.join(found, ["_leaf", "_template"]).select("_leaf", "_key", "_keeper")


def line_dedup(
    docs: DataFrame,
    depth: int = 4,
    min_tokens: int = 3,
    constant_share: float = 0.9,
    similarity: float = 0.6,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``docs`` with the text less its recurring lines, and ``n_lines, n_dropped``.

    Lines are split at line feeds. A tree of fixed depth sorts each by its number of words, then
    its first ``depth`` words; a word with a digit is a variable field. In a leaf with several
    different lines, a place where no word is in ``constant_share`` of them is a variable field
    too, when at least ``similarity`` of the places behind the leading words are constant; otherwise,
    and where there are none, the leaf's lines stay as they are. A template is what is left. It recurs when lines of two documents have it.
    The document with the smallest id keeps its lines of the template (so do all rows with that
    id); every other document loses them. Lines of fewer than ``min_tokens`` words stay, as they
    recur by chance. Texts of any length are taken whole. A null text has no lines and stays null. Rows without an id lose recurring
    lines but don't make lines recur. An empty table gives no rows; other columns pass through,
    those named like helpers too, and those named like a new one are replaced.

    Built-in functions only. Leaves of several documents are found first, from counts; of all other
    lines nothing more is shuffled (a table of bits of fixed size sorts them out, a join makes it
    exact). A line in a third of all documents is one row for each task before it is shuffled. Only
    texts that lose lines meet the numbers of these lines, by id and hash.
    """
    docs, names = set_aside(docs.drop("n_lines", "n_dropped"))
    id_col, text_col = names[id_col], names[text_col]
    marks = {"_id": F.coalesce(F.col(id_col).cast("string"), F.lit("")), "_hash": F.xxhash64(text_col)}
    lines = placed_lines(docs.select(id_col, text_col).withColumns(marks), depth, min_tokens, text_col)
    shared = stored(
        lines.groupBy("_leaf").agg(F.min(id_col).alias("_a"), F.max(id_col).alias("_b")).filter("_a < _b").select("_leaf"), "leaves")
    likely = with_hit(lines, bit_table(shared.select(F.xxhash64("_leaf").alias("id"))), F.xxhash64("_leaf")).filter("_hit").drop("_hit")
    line = masked(F.col("_line"))
    known = stored(
        likely.join(shared, "_leaf").select("_id", "_hash", id_col, "_no", "_leaf", line.alias("_masked"))
        .withColumn("_key", F.unhex(F.md5("_masked"))), "lines")
    each = stored(known.groupBy("_leaf", "_key").agg(
        F.first("_masked").alias("_masked"), F.min(id_col).alias("_a"), F.max(id_col).alias("_b")), "each")
    lost = stored(
        known.drop("_masked").join(_recurring(each, depth, constant_share, similarity), ["_leaf", "_key"])
        .filter(~F.col(id_col).eqNullSafe(F.col("_keeper")))
        .groupBy("_id", "_hash").agg(F.collect_set("_no").alias("_lost")), "lost")
    every = with_hit(docs.withColumns(marks), bit_table(lost.select(F.xxhash64("_id", "_hash").alias("id"))), F.xxhash64("_id", "_hash"))
    whole = every.filter("not _hit").withColumn("_lost", F.lit(None).cast("array<int>"))
    cut = every.filter("_hit").join(lost, ["_id", "_hash"], "left")
    columns = [*docs.columns, "_lost"]
    parts = F.split(F.col(text_col), "\n")
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("_parts") - 1), F.col("_lost")))
    text = F.when(F.col("_lost").isNull(), F.col(text_col)).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get(F.col("_parts"), i)), "\n"))
    out = whole.select(*columns).union(cut.select(*columns)).withColumn("_parts", parts).select(
        *(text.alias(c) if c == text_col else F.col(c) for c in docs.columns),
        F.when(F.col(text_col).isNull(), 0).otherwise(F.size("_parts")).alias("n_lines"),
        F.when(F.col("_lost").isNull(), 0).otherwise(F.size("_lost")).alias("n_dropped"))
    return put_back(out, names)
