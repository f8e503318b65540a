"""Evaluation texts leaking into training text.

Words are reduced to templates: numbers, codes, units and names become typed placeholders, other words stay
themselves. Windows of template words of the documents are hash-joined with those of the items. Slots are
numbered within their window, so that two windows join exactly if a one-to-one renaming per type leads from one
to the other; the words themselves tell whether the passage leaked as it is or re-parameterised.

Which words are names and units is learned from the items and kept in bit tables of bounded size. Both sides
read the same tables, so a false entry makes a word a placeholder on both sides and loses no match.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fareline.llm.canonical import canonical_batch
from fareline.operators.skew import hot_keys, skew_join
from fareline.session import checkpoint

WINDOW = 12
#: Item windows, as counted, up to which they are broadcast for the join; beyond, both sides are shuffled.
BROADCAST_WINDOWS = 100_000
#: Bits of a table at most (16 MB); with more words or windows than it can tell apart, more windows are joined.
MAX_BITS = 2**27
#: A word is a unit if it follows a number in at least this share of its places.
UNIT_SHARE = 0.5
#: Words kept in a worker's table of codes before it starts anew.
CACHE_WORDS = 1_000_000
#: Literal words that a window needs to count as re-parameterised.
LEAST_LITERALS = 6

WORD = re.compile(r"[^\W_]+")
NUMBER, CODE, UNIT, NAME = range(1, 5)
#: Template codes from here on are literals.
TYPES = 5


def fold(word: str) -> str:
    return word.casefold()


def words_of(form: str) -> list[str]:
    """The longest runs of letters and digits of a text in its consistent form."""
    return WORD.findall(form)


def word_hash(folded: str) -> int:
    return xxhash.xxh3_64_intdigest(folded.encode())


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a 64-bit hash in a table of ``bits`` (a power of two, at most 2**32)."""
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def _holds(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), dtype=bool)
    for s in _slots(h, len(table) * 64):
        hit &= (table[s >> np.uint64(6)] >> (s & np.uint64(63))) & np.uint64(1) == 1
    return hit


def _bit_tables(hashes: DataFrame, kinds: int, bits: int) -> list[np.ndarray]:
    """Tables of the rows (kind, h). Words are or-ed before the shuffle; what reaches the driver is bounded by MAX_BITS."""
    mask = F.lit(bits - 1)
    slots = hashes.select("kind", F.explode(F.array(F.col("h").bitwiseAND(mask), F.shiftrightunsigned("h", 32).bitwiseAND(mask))).alias("s"))
    words = slots.select("kind", F.shiftright("s", 6).alias("w"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("m")).groupBy("kind", "w").agg(F.bit_or("m").alias("m")).toPandas()
    tables = []
    for k in range(kinds):
        own, table = words[words["kind"] == k], np.zeros(bits // 64, dtype=np.uint64)
        table[own["w"].to_numpy(dtype=np.int64)] = own["m"].to_numpy(dtype=np.int64).view(np.uint64)
        tables.append(table)
    return tables


@dataclass(frozen=True)
class Lexicon:
    """Bit tables of the items' words, names and units."""

    words: np.ndarray
    names: np.ndarray
    units: np.ndarray

    def code(self, word: str) -> tuple[int, int]:
        """(template code, 32-bit code of the word itself); template code 0: a word that no item has."""
        folded = fold(word)
        full = word_hash(folded)
        h, own = np.array([full], dtype=np.uint64), full & 0xFFFFFFFF
        if folded.isdigit():
            return NUMBER, own
        if any(c.isdigit() for c in folded):
            return CODE, own
        for table, kind in ((self.units, UNIT), (self.names, NAME)):
            if _holds(table, h)[0]:
                return kind, own
        if _holds(self.words, h)[0]:
            return (full >> 34) + TYPES, own
        return (NAME if word[0].isupper() else 0), own


class _Codes(dict):
    """Both codes of a word packed into one integer, by word as written."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        template, own = self.lexicon.code(word)
        self[word] = template << 32 | own
        return self[word]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: codes to hashes."""
    x = (x + np.uint64(0x9E3779B97F4A7C15)).astype(np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _combined(columns: list[np.ndarray]) -> np.ndarray:
    out = np.zeros(len(columns[0]), dtype=np.uint64)
    for c in columns:
        out *= np.uint64(0x100000001B3)
        out += _mix(c)
    return _mix(out)


def window_hashes(template: np.ndarray) -> np.ndarray:
    """A hash for each window of WINDOW template codes."""
    n = len(template) - WINDOW + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    hashed, out = _mix(template.astype(np.uint64)), np.zeros(n, dtype=np.uint64)
    for j in range(WINDOW):
        out *= np.uint64(0x100000001B3)
        out += hashed[j : j + n]
    return _mix(out)


def numbered_hashes(template: np.ndarray, own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Hashes of the windows that begin at ``at``, a slot whose value occurred before in the window marked by
    how far back: windows with one template agree in this exactly if their slots are a renaming of each other."""
    t = [template[at + j] for j in range(WINDOW)]
    v = [own[at + j] for j in range(WINDOW)]
    columns = []
    for j in range(WINDOW):
        back = np.zeros(len(at), dtype=np.int64)
        for i in range(j):  # the nearest equal slot is written last
            back[(t[j] < TYPES) & (t[i] == t[j]) & (v[i] == v[j])] = j - i
        columns.append((t[j].astype(np.int64) * WINDOW + back).astype(np.uint64))
    return _combined(columns)


def _typed(codes: _Codes, lists: list[list[str]], starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(template codes, word codes) of all words of a batch, end to end."""
    packed = np.fromiter((codes[w] for ws in lists for w in ws), dtype=np.int64, count=int(starts[-1]))
    template, own = packed >> 32, packed & 0xFFFFFFFF
    if len(template) > 1:  # an unknown word after a number is a unit that the items do not have
        template[1:][(template[1:] == 0) & (template[:-1] == NUMBER)] = UNIT
    return template, own


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list, list[str]]]:
    import duckdb

    with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": ""}) as db:
        for batch in batches:
            if batch.num_rows:
                forms = canonical_batch(db, batch, "text", "SELECT key, {form} AS text FROM batch WHERE text IS NOT NULL")
                yield batch, forms["key"].to_pylist(), forms["text"].to_pylist()


def learn_lexicon(items: DataFrame, text: str, bits: int) -> Lexicon:
    """Names: words with a capital inside a sentence that are nowhere written small. Units: words that mostly
    follow a number. Counted over all items before the shuffle."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, forms in _forms(batches):
            seen: dict[int, list[int]] = {}
            for form in forms:
                before, end = "", 0
                for m in WORD.finditer(form):
                    inside = form[end : m.start()].strip()[-1:] not in (".", "?", "!", ":") and end > 0
                    c = seen.setdefault(_signed(word_hash(fold(m[0]))), [0, 0, 0, 0])
                    c[0] += 1
                    c[1] += m[0][0].isupper() and inside
                    c[2] += m[0][0].islower()
                    c[3] += before.isdigit() and form[end : m.start()].isspace()
                    before, end = m[0], m.end()
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), *(pa.array([c[i] for c in seen.values()], pa.int64()) for i in range(4))], names=["h", "n", "inner", "lower", "after"])

    rows = items.select(F.lit(0).alias("key"), F.col(text).alias("text")).mapInArrow(places, "h bigint, n bigint, inner bigint, lower bigint, after bigint")
    found = rows.groupBy("h").agg(*[F.sum(c).alias(c) for c in ("n", "inner", "lower", "after")])
    kinds = F.array_compact(F.array(F.lit(0), F.when((F.col("inner") > 0) & (F.col("lower") == 0), 1), F.when((F.col("lower") > 0) & (F.col("after") >= UNIT_SHARE * F.col("n")), 2)))
    return Lexicon(*_bit_tables(found.select("h", F.explode(kinds).alias("kind")), 3, bits))


def template_windows(df: DataFrame, key: str, text: str, lexicon, table=None) -> DataFrame:
    """(key, h, t, e, literals): the windows of each row's text, once each.

    h: hash of the template; t: the same with numbered slots; e: 128-bit hash of the words; literals: words
    that are no slots. ``lexicon`` and ``table`` are broadcasts; with ``table`` only windows whose h may be in it.
    Narrow: documents are read once, and only what may be a passage is kept.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(lexicon.value)
        for batch, keys, forms in _forms(batches):
            lists = [words_of(f) for f in forms]
            starts = np.concatenate(([0], np.cumsum([len(w) for w in lists]))).astype(np.int64)
            template, own = _typed(codes, lists, starts)
            hashes = window_hashes(template)
            at = np.arange(len(hashes)) if table is None else np.flatnonzero(_holds(table.value, hashes))
            owner = np.searchsorted(starts, at, side="right") - 1
            inside = at + WINDOW <= starts[owner + 1]
            at, owner = at[inside], owner[inside]
            numbered = numbered_hashes(template, own, at).view(np.int64)
            literals = sum((template[at + j] >= TYPES).astype(np.int32) for j in range(WINDOW))
            words = [" ".join(map(fold, lists[d][i : i + WINDOW])) for d, i in zip(owner.tolist(), (at - starts[owner]).tolist())]
            exact = [xxhash.xxh3_128_hexdigest(w.encode()) for w in words]
            once = list({(d, e): i for i, (d, e) in enumerate(zip(owner.tolist(), exact))}.values())
            for a in range(0, len(once), 20_000):
                part = once[a : a + 20_000]
                pick = np.array(part, dtype=np.int64)
                columns = [pa.array([keys[owner[i]] for i in part], batch.column(0).type), pa.array(hashes[at[pick]].view(np.int64)), pa.array(numbered[pick]), pa.array([exact[i] for i in part], pa.string()), pa.array(literals[pick], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "h", "t", "e", "literals"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, h bigint, t bigint, e string, literals int")


class Passages:
    """Windows of the items, and those of the documents that may be theirs.

    The same steps whatever the size of the items: lexicon and filter are bit tables of at most MAX_BITS, item
    windows a relation in shared storage. Only the join depends on their number: broadcast or salted shuffle.
    """

    def __init__(self, documents: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str):
        context = documents.sparkSession.sparkContext
        rows = items.where(F.col(item_text).isNotNull())
        letters = rows.agg(F.sum(F.length(item_text))).first()[0] or 0
        bits = min(MAX_BITS, 1 << max(16, (4 * letters).bit_length()))
        lexicon = context.broadcast(learn_lexicon(rows, item_text, bits))
        windows = checkpoint(template_windows(rows, item_key, item_text, lexicon))
        table = _bit_tables(windows.select(F.lit(0).alias("kind"), "h"), 1, bits)[0]
        self.few = windows.count() <= BROADCAST_WINDOWS
        self.items = windows.withColumnRenamed("key", "item").drop("h")
        self.found = template_windows(documents.where(F.col(text).isNotNull()), key, text, lexicon, context.broadcast(table)).drop("h")

    def joined(self, windows: DataFrame, others: DataFrame, on: str, how: str) -> DataFrame:
        """Windows of documents with those of items (``on``: a text column of both). A passage of a template that a
        third of all documents hold is salted."""
        if self.few:
            return windows.join(F.broadcast(others), on, how)
        return skew_join(windows, others, on, how, hot=hot_keys(windows, on, 250_000))


def leaked_passages(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(key, item key, exact_windows) for each document that holds a passage of an item.

    A passage is WINDOW consecutive words, whatever their case and what is between them, once both texts have
    their consistent form. exact_windows: different windows held, template, slots and words alike. Null and
    short texts hold none; rows with one key count as one text. Documents are read once; see ``Passages``.
    """
    p = Passages(documents, items, key, text, item_key, item_text)
    both = F.concat(F.hex("t"), "e").alias("k")
    own = p.found if p.few else checkpoint(p.found)
    hits = p.joined(own.select("key", both), p.items.select("item", both).distinct(), "k", "inner").distinct()
    return hits.groupBy(F.col("key").alias(key), F.col("item").alias(item_key)).agg(F.count(F.lit(1)).alias("exact_windows"))


def renamed_passages(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least_literals: int = LEAST_LITERALS) -> DataFrame:
    """(key, class_id, renamed_windows, exact_windows) for each document that holds a passage of an item under
    other numbers, codes, units or names.

    renamed_windows: different windows of the document whose template and slot pattern, but not words, some item
    has. Items that share a template are one class, named by the least item key that has it, so a document
    comes out once per class and not once per item; exact_windows marks those that also hold an item of the class
    word by word. Windows need ``least_literals`` literal words. ``template_classes`` has the classes' items.
    """
    p = Passages(documents, items, key, text, item_key, item_text)
    enough = F.col("literals") >= least_literals
    t = F.hex("t").alias("k")
    classes = p.items.where(enough).groupBy(t).agg(F.min("item").alias("class_id"))
    both = F.concat(F.hex("t"), "e").alias("ke")
    words = p.items.where(enough).select(both).distinct().withColumn("same", F.lit(True))
    own = p.found.where(enough) if p.few else checkpoint(p.found.where(enough))
    hits = p.joined(own.select("key", t, both), classes, "k", "inner").drop("k")
    hits = p.joined(hits, words, "ke", "left").distinct()  # rows with one key are one text
    out = hits.groupBy(F.col("key").alias(key), "class_id").agg(F.count(F.when(F.col("same").isNull(), 1)).alias("renamed_windows"), F.count("same").alias("exact_windows"))
    return out.where("renamed_windows > 0")


def template_classes(items: DataFrame, item_key: str = "item_id", item_text: str = "text", least_literals: int = LEAST_LITERALS) -> DataFrame:
    """(item key, class_id, windows): the template classes of each item and how many of its windows are in them."""
    p = Passages(items.limit(0), items, item_key, item_text, item_key, item_text)
    rows = p.items.where(F.col("literals") >= least_literals)
    classes = rows.groupBy("t").agg(F.min("item").alias("class_id"))
    return rows.join(classes, "t").groupBy(F.col("item").alias(item_key), "class_id").agg(F.countDistinct("t").alias("windows"))
