"""Repeated passages across documents, by sliding spans of sentences.

From every sentence the shortest run of several sentences with enough words is hashed, forwards and backwards, so
that a repeated passage is covered to both its ends. Runs are joined on their hashes over all documents; the first
occurrence (smallest doc_id, then position) stays, sentences covered by any other are removed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calzada.llm.bpe import slices
from calzada.llm.rows import told_apart
from calzada.sources.workspace import materialise

SENTENCE = regex.compile(r"[^.!?\n]*(?:[.!?]+|\n|$)[ \t\r\x0b\f\n]*")
SPANS = "doc_id bigint, copy bigint, start int, stop int, h bigint, g bigint"


def sentences(text: str | None) -> list[str]:
    """The text cut after runs of . ! ? and after line ends; the parts put together are the text."""
    return [s for s in SENTENCE.findall(text) if s] if text else []


def spans(parts: list[str], least_words: int, least_sentences: int, lone_words: int) -> list[tuple[int, int]]:
    """(start, stop) of the runs to hash. A sentence of ``lone_words`` or more is a run by itself."""
    words = [len(p.split()) for p in parts]
    full = [i for i, n in enumerate(words) if n]
    sizes = [words[i] for i in full]
    sums = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    n = len(full)
    if not n:
        return []
    at = np.arange(n)
    ahead = np.maximum(np.searchsorted(sums, sums[:-1] + least_words), at + least_sentences)
    back = np.minimum(np.searchsorted(sums, sums[1:] - least_words, "right") - 1, at + 1 - least_sentences)
    found = {(i, j) for i, j in enumerate(ahead.tolist()) if j <= n} | {(i, j + 1) for j, i in enumerate(back.tolist()) if i >= 0}
    found |= {(i, i + 1) for i in range(n) if sizes[i] >= lone_words}
    return [(full[i], full[j - 1] + 1) for i, j in sorted(found)]


def hashed_spans(docs: DataFrame, least_words: int, least_sentences: int, lone_words: int) -> DataFrame:
    """(doc_id, copy, start, stop, h, g): every run of every document (doc_id, text, copy) with a 128-bit hash of its words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(batch.column(1)):
                own, starts, stops, hashes = [], [], [], []
                for offset, text in enumerate(part.to_pylist()):
                    parts = sentences(text)
                    clean = [" ".join(p.split()) for p in parts]
                    for i, j in spans(parts, least_words, least_sentences, lone_words):
                        own.append(at + offset)
                        starts.append(i)
                        stops.append(j)
                        hashes.append(xxhash.xxh3_128_digest(" ".join(clean[i:j])))
                pair = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
                rows = pa.array(own, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(rows), batch.column(2).take(rows), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()),
                     pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["doc_id", "copy", "start", "stop", "h", "g"])
                at += len(part)

    return docs.select("doc_id", "text", "copy").mapInArrow(run, SPANS)


def repeated(docs: DataFrame, least_words: int = 25, least_sentences: int = 2, lone_words: int = 50) -> DataFrame:
    """(doc_id, copy, cuts): ranges of sentences covered by runs that occur earlier, of documents (doc_id, text, copy)."""
    runs = hashed_spans(docs, least_words, least_sentences, lone_words)
    # Counting combines map-side; only runs whose hash occurs again go on.
    again = materialise(runs.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "spans-again")
    shared = materialise(runs.join(again, "h", "left_semi"), "spans-shared")
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "copy", "start")
    first = materialise(shared.groupBy("h", "g").agg(F.min(place).alias("first")), "spans-first")
    later = shared.join(first, ["h", "g"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "copy").agg(F.collect_set(F.struct("start", "stop")).alias("cuts"))


def without_repeats(docs: DataFrame, least_words: int = 25, least_sentences: int = 2, lone_words: int = 50) -> DataFrame:
    """doc_id, n_sentences, n_removed, text (what is left) for every row.

    NULL text stays NULL with no sentences. A NULL doc_id comes last in the order. Rows that repeat doc_id and text count
    as one document, all others as documents of their own. An empty table gives no rows. Other columns are ignored.
    """
    docs = told_apart(docs)
    cuts = materialise(repeated(docs, least_words, least_sentences, lone_words), "spans-cuts").withColumnsRenamed({"doc_id": "cut_id", "copy": "cut_copy"})
    own = F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("copy") == F.col("cut_copy"))
    rows = docs.join(cuts, own, "left").select("doc_id", "text", "cuts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for texts in slices(batch.column(1)):
                cut = batch.column(2).slice(at, len(texts)).to_pylist()
                total, removed, left = [], [], []
                for text, ranges in zip(texts.to_pylist(), cut):
                    parts = sentences(text)
                    gone = {i for r in ranges or () for i in range(r["start"], r["stop"])}
                    total.append(len(parts))
                    removed.append(len(gone & set(range(len(parts)))))
                    left.append(text if not gone else "".join(p for i, p in enumerate(parts) if i not in gone))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array(total, pa.int32()), pa.array(removed, pa.int32()),
                                                  pa.array(left, pa.string())], ["doc_id", "n_sentences", "n_removed", "text"])
                at += len(texts)

    return rows.mapInArrow(run, "doc_id bigint, n_sentences int, n_removed int, text string")
