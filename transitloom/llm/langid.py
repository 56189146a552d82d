"""Language identification by language-bitmask n-gram filters.

A text is folded to lower-case letters and single spaces, and cut into runs of two to four characters. Each
language has a Bloom filter of the n-grams it contains: those that make up at least FLOOR of its n-grams, and
are not RATIO times as common in another. The filters lie bit-sliced in one table: a slot holds one bit of every language, so
the AND of an n-gram's slots is the set of all languages that contain it. The set bits of each language are counted
over the text, and the count is corrected for the false positives its filter is expected to give. The language with the
largest corrected count is predicted; the score is its part of all corrected counts.

The filters are fitted on a bounded sample of labelled texts, SAMPLE for each language, and hold at most 1 / FLOOR
n-grams a language. Every text is predicted from all of its characters.

Nulls: a null language is not learned from, a null text and one without a letter is `und` with score 0. A null id keeps its row; it is
not held out and not learned from. Rows that repeat get the same prediction. Ties go to the language first by code point. A text of none of the
known n-grams gets the language with most labelled texts and score 0. Where nothing can be learned all texts are `und`; an empty table gives
an empty result. Other columns pass through.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from transitloom.llm.text import free_name, sliced

Store = Callable[[DataFrame, str], DataFrame]
ORDERS = (2, 3, 4)
SAMPLE = 5000
FLOOR = 2e-5
RATIO = 20
SLOTS_PER_GRAM = 10
PROBES = 3
ROWS = 1024
# Characters looked at together.
CHUNK = 1 << 20
UNKNOWN = "und"
_ODD = np.random.default_rng(13).integers(0, 2**63, size=max(ORDERS) + 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def folding() -> tuple[np.ndarray, np.ndarray]:
    """For each code point its lower-case form, or a space if it is neither a letter nor a mark on one; and whether it is a letter."""
    kinds = [unicodedata.category(chr(c))[0] for c in range(sys.maxunicode + 1)]
    low = [chr(c).lower() if k == "L" else chr(c) if k == "M" else " " for c, k in enumerate(kinds)]
    return np.array([ord(x) if len(x) == 1 else c for c, x in enumerate(low)], np.uint32), np.array([k == "L" for k in kinds])


def folded(text: str, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The text's letters in lower case, a single space between words and at both ends; empty without a letter."""
    fold, letter = tables
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not letter[raw].any():
        return np.zeros(0, np.uint32)
    codes = np.concatenate([[np.uint32(32)], fold[raw], [np.uint32(32)]])
    return codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]


def chunks(texts: Iterator[tuple[int, np.ndarray]], size: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Folded texts joined up to `size` characters, or cut: characters, the owner of each, and whether an n-gram may start there.

    A piece of a cut text repeats the first characters of the next, where none of its own n-grams start.
    """
    held, total = [], 0
    for owner, codes in texts:
        for at in range(0, len(codes), size):
            piece = codes[at:at + size + max(ORDERS) - 1]
            if total and total + len(piece) > size:
                yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                held, total = [], 0
            held.append((piece, np.full(len(piece), owner, np.int64), np.arange(len(piece)) < size))
            total += len(piece)
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def grams(codes: np.ndarray, owner: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash and owner of every n-gram of each order that lies within one owner."""
    wide = codes.astype(np.uint64)
    for n in ORDERS:
        size = max(len(wide) - n + 1, 0)
        h = np.full(size, (int(_ODD[-1]) * n) & (1 << 64) - 1, np.uint64)
        for i in range(n):
            h = (h ^ wide[i:i + size]) * _ODD[i]
            h ^= h >> np.uint64(29)
        inside = (owner[n - 1:] == owner[:size]) & starts[:size]
        yield h[inside], owner[:size][inside]


def slots_of(h: np.ndarray, slots: int) -> Iterator[np.ndarray]:
    """The slots of each n-gram; `slots` is a power of two."""
    step = (h * _ODD[-2]) >> np.uint64(32) | np.uint64(1)
    for i in range(PROBES):
        yield ((h >> np.uint64(7)) + np.uint64(i) * step) & np.uint64(slots - 1)


@dataclass(frozen=True)
class Model:
    """Languages, the bit-sliced table (slot, byte of the mask), and the false-positive rate of each language's filter."""

    languages: list[str]
    table: np.ndarray
    false_rate: np.ndarray
    commonest: int

    def counted(self, texts: list[str | None], tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text whether it has a letter, its number of n-grams, and how many of them each language contains."""
        made = ((i, folded(t, tables)) for i, t in enumerate(texts) if t)
        seen, hits = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.languages)))
        for piece in chunks(made):
            for h, of in grams(*piece):
                at = list(slots_of(h, len(self.table)))
                mask = self.table[at[0]]
                for more in at[1:]:
                    mask &= self.table[more]
                seen += np.bincount(of, minlength=len(texts))
                for k in range(len(self.languages)):
                    hits[:, k] += np.bincount(of[(mask[:, k >> 3] >> np.uint8(k & 7) & np.uint8(1)).astype(bool)], minlength=len(texts))
        return seen > 0, seen, hits

    def predict(self, texts: list[str | None], tables: tuple[np.ndarray, np.ndarray]) -> tuple[list[str], np.ndarray]:
        lettered, seen, hits = self.counted(texts, tables)
        right = np.maximum(hits - seen[:, None] * self.false_rate, 0) / (1 - self.false_rate)
        best, total = right.argmax(axis=1), right.sum(axis=1)
        best = np.where(total > 0, best, self.commonest)
        score = np.divide(right.max(axis=1), total, out=np.zeros(len(texts)), where=total > 0)
        return [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered, strict=True)], score


def build(languages: list[str], entries: list[tuple[int, int]], commonest: int) -> Model:
    """The table of all languages' filters from pairs of n-gram and language."""
    gram = np.array([g for g, _ in entries], np.int64).view(np.uint64)
    of = np.array([k for _, k in entries], np.int64)
    most = int(np.bincount(of, minlength=1).max()) if len(of) else 1
    slots = 1 << max(12, (SLOTS_PER_GRAM * most - 1).bit_length())
    table = np.zeros((slots, -(-len(languages) // 8)), np.uint8)
    for at in slots_of(gram, slots):
        np.bitwise_or.at(table, (at.astype(np.int64), of >> 3), np.left_shift(1, of & 7).astype(np.uint8))
    filled = np.array([(table[:, k >> 3] >> (k & 7) & 1).mean() for k in range(len(languages))])
    return Model(languages, table, np.minimum(filled ** PROBES, 0.99), commonest)


def train(labelled: DataFrame, store: Store, text: str = "text", language: str = "lang", sample: int = SAMPLE) -> Model | None:
    """A model of the languages of `labelled`; none without a labelled text that has n-grams.

    The sample is drawn by a hash of the text, with the share that gives about `sample` texts a language. `store`
    writes a frame to the shared folder and reads it back.
    """
    usable = labelled.where(F.col(language).isNotNull() & F.col(text).isNotNull()).select(
        F.col(language).cast("string").alias("language"), F.col(text).alias("text"))
    held = sorted((r["language"], r["count"]) for r in usable.groupBy("language").count().collect())
    if not held:
        return None
    languages = [name for name, _ in held]
    number = F.create_map(*(F.lit(x) for i, name in enumerate(languages) for x in (name, i)))[F.col("language")]
    share = F.create_map(*(F.lit(x) for name, n in held for x in (name, min(1.0, sample / n))))[F.col("language")]
    drawn = usable.where(F.pmod(F.xxhash64("text", F.lit(13)), F.lit(1 << 20)) < share * (1 << 20)).select(number.alias("language"), "text")
    tables = folding()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = batch.column(0).to_numpy()
            texts = batch.column(1)
            for piece in chunks((int(k), folded(t.as_py(), tables)) for k, t in zip(of, texts, strict=True)):
                for h, k in grams(*piece):
                    for one in np.unique(k):
                        gram, n = np.unique(h[k == one], return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), one, np.int32)), pa.array(gram.view(np.int64)), pa.array(n.astype(np.int64))],
                                                         names=["language", "gram", "n"])

    counted = store(drawn.mapInArrow(run, "language int, gram long, n long").groupBy("language", "gram").agg(F.sum("n").alias("n")), "language-grams")
    totals = {r["language"]: r["n"] for r in counted.groupBy("language").agg(F.sum("n").alias("n")).collect()}
    if not totals:
        return None
    part = F.col("n") / F.create_map(*(F.lit(x) for kv in totals.items() for x in kv))[F.col("language")]
    common = counted.withColumn("part", part).withColumn("most", F.max("part").over(W.partitionBy("gram")))
    entries = common.where((F.col("part") >= FLOOR) & (F.col("part") * RATIO >= F.col("most"))).select("gram", "language").collect()
    return build(languages, [(r["gram"], r["language"]) for r in entries], max(range(len(held)), key=lambda i: (held[i][1], -i)))


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> tuple[DataFrame, str, str]:
    """`docs` with the predicted language and its score, and the names of these two columns."""
    guess, sure = free_name(docs.columns, "lang_pred"), free_name(docs.columns, "score")
    if model is None:
        return docs.withColumns({guess: F.lit(UNKNOWN), sure: F.lit(0.0)}), guess, sure
    tables = folding()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, ROWS):
            said, score = model.predict(batch.column(batch.schema.get_field_index(text)).to_pylist(), tables)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(said, pa.string()), pa.array(score)], names=[*batch.schema.names, guess, sure])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(guess, T.StringType()), T.StructField(sure, T.DoubleType())])), guess, sure


def fold_of(id: Column, folds: int = 5) -> Column:
    return F.crc32(id.cast("string").cast("binary")) % folds


def held_out(docs: DataFrame, store: Store) -> DataFrame:
    """Predictions for all documents of a model that has learned from four of five folds."""
    model = train(docs.where(fold_of(F.col("doc_id")) != 0), store)
    out = F.coalesce(fold_of(F.col("doc_id")) == 0, F.lit(False))
    found, guess, sure = identify(docs.select("doc_id", "text", out.alias("held_out")), model)
    return found.select("doc_id", "held_out", F.col(guess).alias("lang_pred"), F.col(sure).alias("score"))
