"""Language identification by compression.

Every language has a dictionary of raw text. A text is cut into pieces, each piece is compressed with each
dictionary, and the language with the fewest bytes in all is chosen. A narrow margin to the second is a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calzada.llm.bpe import slices
from calzada.sources.workspace import materialise

UNKNOWN = "und"
# A dictionary is made of up to SAMPLES excerpts of EXCERPT characters, one document each.
SAMPLES, EXCERPT = 256, 1_000
# Languages learned at most, those of the most rows: dictionaries, and the time a text takes, grow with their number.
LANGUAGES = 200
# Pieces are compressed on their own, so that a long text does not become its own dictionary.
PIECE = 4_096
LEVEL = 3
NARROW = 0.003
RESULT = "lang string, score double, rejected boolean"
LETTER = regex.compile(r"\p{L}")


def learn(docs: DataFrame, samples: int = SAMPLES, excerpt: int = EXCERPT, languages: int = LANGUAGES) -> dict[str, bytes]:
    """Raw-content dictionaries from (doc_id, text, lang): a bounded sample of labelled rows, the same on every run.

    Rows are dealt into ``samples`` cells by a hash, of each language and cell the lowest hash is taken. Only
    identifiers are aggregated (map-side); the excerpts chosen are fetched afterwards. Frequent languages come first;
    beyond the first ``languages`` ones none is learned, so at most languages * samples * excerpt characters reach the driver.
    """
    found: dict[str, dict] = {}
    counts: dict[str, dict] = {}
    for r in excerpts(docs, samples, excerpt, languages).collect():
        found.setdefault(r.lang, {})[r.doc_id] = r.piece
        counts.setdefault(r.lang, {})[r.doc_id] = r.n
    order = sorted(found, key=lambda lang: (-sum(counts[lang].values()), lang))
    return {lang: "\n".join(found[lang][k] for k in sorted(found[lang])).encode() for lang in order}


def excerpts(docs: DataFrame, samples: int, excerpt: int, languages: int = LANGUAGES) -> DataFrame:
    """(lang, doc_id, n, piece), one row for each chosen document, however many rows repeat its doc_id."""
    labelled = docs.select("doc_id", "lang", "text").where("doc_id IS NOT NULL AND lang IS NOT NULL AND length(text) > 0")
    draw = F.xxhash64("doc_id", F.lit("language"))
    chosen = labelled.groupBy("lang", F.pmod(draw, F.lit(samples)).alias("cell")).agg(
        F.count("*").alias("n"), F.min(F.struct(draw.alias("draw"), "doc_id")).alias("best")).select("lang", "n", F.col("best.doc_id").alias("doc_id"))
    chosen = materialise(chosen, "language-chosen")
    most = materialise(chosen.groupBy("lang").agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), "lang").limit(languages).select("lang"), "language-most")
    # The written choice has its true size, so it is sent to the documents; texts are cut before anything of them could move.
    start = F.pmod(draw, F.greatest(F.lit(1), F.length("text") - excerpt)).cast("int") + 1
    pieces = labelled.select("lang", "doc_id", F.lower(F.substring("text", start, F.lit(excerpt))).alias("piece"))
    rows = pieces.join(chosen.join(most, "lang", "left_semi"), ["lang", "doc_id"])
    return rows.groupBy("lang", "doc_id").agg(F.max("n").alias("n"), F.max("piece").alias("piece"))


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes], narrow: float = NARROW):
        self.narrow, self.names = narrow, list(dictionaries)
        self.sizes = [self._size(raw, LEVEL) for raw in dictionaries.values()]

    @staticmethod
    def _size(raw: bytes, level: int):
        data = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(level=level)
        return zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False).compress

    def classify(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.names or not LETTER.search(text):
            return UNKNOWN, 0.0, True
        data = text.lower().encode("utf-8", "surrogatepass")
        pieces = [data[i:i + PIECE] for i in range(0, len(data), PIECE)]
        totals = sorted(((sum(len(size(p)) for p in pieces), name) for name, size in zip(self.names, self.sizes)), key=lambda x: x[0])
        if len(totals) == 1:
            return totals[0][1], 1.0, False
        margin = 1 - totals[0][0] / totals[1][0]
        return totals[0][1], min(1.0, 0.5 + 2 * margin), margin < self.narrow


def language(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", narrow: float = NARROW) -> Column:
    """struct(lang, score, rejected) of a text column; ``und`` if it is NULL or has no letter, or nothing was learned.

    score is 0.5 without any margin and 1 from a margin of a quarter on; ties go to the language learned from more rows. The
    dictionaries are broadcast: at most SAMPLES * EXCERPT characters for each language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.arrow_udf(RESULT)
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = Classifier(shared.value, narrow)
        for batch in batches:
            rows = [model.classify(t) for part in slices(batch) for t in part.to_pylist()]
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.bool_())],
                                             ["lang", "score", "rejected"])

    return predict(F.col(text).cast("string"))


def held_out(folds: int, which: int) -> Column:
    """True for the documents of one fold by CRC-32 of the decimal doc_id; a NULL doc_id is never held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == which, F.lit(False))


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every row; learned from rows with a lang outside fold 1 of 3.

    An empty table gives no rows; repeated rows get the same prediction each. Other columns are ignored.
    """
    docs = docs.select("doc_id", "text", "lang")
    model = learn(docs.where(~held_out(3, 1)))
    rows = docs.select("doc_id", held_out(3, 1).alias("held_out"), language(docs, model).alias("p"))
    return rows.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.rejected")


def drop_rejected(docs: DataFrame) -> DataFrame:
    """Documents whose language is clear, with all their columns."""
    model = learn(docs.where(~held_out(3, 1)))
    return docs.select(F.struct("*").alias("doc"), language(docs, model).alias("p")).where("NOT p.rejected").select("doc.*")
