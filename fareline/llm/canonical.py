"""One form for texts that look the same.

DuckDB runs inside the Arrow partitions: ``translate``, ``replace`` and ``nfc_normalize`` in embedded SQL.
The translation tables are not written out: they are derived by rule for the characters that a batch holds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareline.operators.skew import HOT_KEYS, skew_join
from fareline.session import checkpoint

# Letters of other scripts and the Latin letters they look like, position by position.
CYRILLIC = "аеорсухіјѕһԁԛԝѵАВЕКМНОРСТУХІЈЅԚԜ"
CYRILLIC_AS = "aeopcyxijshdqwvABEKMHOPCTYXIJSQW"
GREEK = "οϳνΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
GREEK_AS = "ojvABEZHIKMNOPTYX"
# Hyphens and signs that have no decomposition to the plain sign.
HYPHENS = "‐‑‒–⁃˗−"
QUOTES = {"‘": "'", "’": "'", "ʼ": "'", "“": '"', "”": '"'}
# Decomposition types of characters that are another form of the same character.
SAME_FORM = frozenset({"<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>", "<small>", "<isolated>", "<initial>", "<medial>", "<final>"})
# Characters without width that are not of the category Cf.
NO_WIDTH = frozenset({"͏", "ᅟ", "ᅠ", "឴", "឵", "ㅤ", "ﾠ"})

LOOK_ALIKE = dict(zip(CYRILLIC + GREEK, CYRILLIC_AS + GREEK_AS))


def plain_form(ch: str) -> str:
    """The consistent form of one character: '' for one without width, several letters for joined ones.

    Compatibility forms that look different (superscripts, fractions, circled and squared signs) stay.
    """
    if ch.isascii():
        return ch
    category = unicodedata.category(ch)
    if category == "Cf" or ch in NO_WIDTH or "︀" <= ch <= "️" or "\U000e0100" <= ch <= "\U000e01ef":
        return ""
    if category == "Zs":
        return " "
    if ch in HYPHENS:
        return "-"
    if ch in QUOTES:
        return QUOTES[ch]
    kind = unicodedata.decomposition(ch).partition(" ")[0]
    form = unicodedata.normalize("NFKC", ch) if kind in SAME_FORM else ch
    if form != ch and form[0] == " " and len(form) > 1:
        form = ch  # a spacing accent is not a blank
    if form in HYPHENS:
        return "-"
    # a letter with an accent that looks like a Latin one with the same accent
    return unicodedata.normalize("NFC", "".join(LOOK_ALIKE.get(c, c) for c in unicodedata.normalize("NFD", form)))


def canonical(text: str) -> str:
    """The same form without DuckDB, for single texts and tests."""
    return unicodedata.normalize("NFC", "".join(map(plain_form, text)))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(column: str, characters: Iterable[str]) -> str:
    """SQL for the consistent form of texts made of these characters."""
    changed = {c: f for c in sorted(characters) if (f := plain_form(c)) != c}
    one = [c for c, f in changed.items() if len(f) == 1]
    none = [c for c, f in changed.items() if not f]
    sql = column
    if one:
        sql = f"translate({sql}, {_quoted(''.join(one))}, {_quoted(''.join(changed[c] for c in one))})"
    if none:
        sql = f"regexp_replace({sql}, {_quoted('[' + ''.join(f'\\x{{{ord(c):X}}}' for c in none) + ']')}, '', 'g')"
    for c, f in changed.items():
        if len(f) > 1:
            sql = f"replace({sql}, {_quoted(c)}, {_quoted(f)})"
    return f"nfc_normalize({sql})"


def characters_of(column: pa.ChunkedArray | pa.Array) -> set[str]:
    """The characters beyond ASCII in a column of texts."""
    found: set[str] = set()
    for text in column.to_pylist():
        if text is not None and not text.isascii():
            found.update(text)
    return {c for c in found if not c.isascii()}


def canonical_batch(db, batch: pa.RecordBatch, column: str, select: str) -> pa.Table:
    """``select`` over the batch, in which {form} stands for the consistent form of ``column``.

    Texts in ASCII pass unchanged.
    """
    form = canonical_sql(f'"{column}"', characters_of(batch.column(column)))
    db.register("batch", pa.Table.from_batches([batch]))
    return db.sql(select.format(form=f'CASE WHEN strlen("{column}") = length("{column}") THEN "{column}" ELSE {form} END')).to_arrow_table()


def with_canonical(df: DataFrame, text: str, key: str, select: str, schema: str) -> DataFrame:
    """Narrow: ``select`` (with {form}) per Arrow batch over (key, text); no shuffle, any length of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as db:
            for batch in batches:
                if batch.num_rows:
                    yield from canonical_batch(db, batch, "text", select).to_batches()

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def canonical_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text) with each text in its consistent form; null stays null, empty stays empty."""
    kind = df.schema[key].dataType.simpleString()
    return with_canonical(df, text, key, "SELECT key, {form} AS text FROM batch", f"key {kind}, text string").withColumnRenamed("key", key)


def look_alike_classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, form_id, text_id): 128-bit fingerprints of the consistent form and of the text as it is.

    Null texts are left out.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.where(F.col(text).isNotNull())
    return with_canonical(rows, text, key, "SELECT key, md5({form}) AS form_id, md5(text) AS text_id FROM batch", f"key {kind}, form_id string, text_id string").withColumnRenamed("key", key)


def look_alike_pairs(classes: DataFrame, key: str = "doc_id", max_rows: int = 250_000) -> DataFrame:
    """(key_1, key_2), smaller first: rows whose texts differ but have one form.

    Texts that are equal are counted before any shuffle of rows; only classes with different texts are joined,
    text against text and then with their rows, so equal rows are never paired with each other. The
    fingerprints, and the links of texts, are kept in shared storage, so every text is read once.

    Skew: of two linked texts the more frequent one is joined with its rows first, and the rows of a text with
    over max_rows of them are salted, in this join and in the one with the rarer text's rows.
    """
    classes = checkpoint(classes)
    texts = classes.groupBy("form_id", "text_id").agg(F.count(F.lit(1)).alias("n"))
    several = texts.groupBy("form_id").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("form_id")
    a = texts.join(several, "form_id", "left_semi").select("form_id", F.struct("n", "text_id").alias("a"))
    links = a.join(a.withColumnRenamed("a", "b"), "form_id").where("a > b").select("form_id", F.col("a.text_id").alias("text"), F.col("b.text_id").alias("other"), F.col("a.n").alias("n"))
    links = checkpoint(links)
    members = classes.join(links.select("form_id").distinct(), "form_id", "left_semi").select(F.col("text_id").alias("text"), key)
    # at most HOT_KEYS entries each
    hot_a = links.where(F.col("n") > max_rows).select("text", "n").distinct().orderBy(F.desc("n"), "text").limit(HOT_KEYS)
    hot_b = links.groupBy("other").agg(F.sum("n").alias("n")).where(F.col("n") > max_rows).orderBy(F.desc("n"), "other").limit(HOT_KEYS)
    counts_a, counts_b = ({r[0]: r[1] for r in h.collect()} for h in (hot_a, hot_b))
    left = skew_join(members, links.select("text", "other"), "text", "inner", max_rows, hot=(0, counts_a))
    rows = left.select(F.col("other").alias("text"), F.col(key).alias("__1"))
    both = skew_join(rows, members.withColumnRenamed(key, "__2"), "text", "inner", max_rows, hot=(0, counts_b))
    return both.select(F.least("__1", "__2").alias(f"{key}_1"), F.greatest("__1", "__2").alias(f"{key}_2")).where(F.col(f"{key}_1") != F.col(f"{key}_2")).distinct()
