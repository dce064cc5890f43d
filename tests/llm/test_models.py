"""Language and quality on held-out documents and on odd rows; the pipeline stage by stage."""

from __future__ import annotations

import subprocess
import sys
import zlib

import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

import corpus_pipeline
from calzada.llm import language, quality

BIG = SF_DIR.replace("sf0.001", "sf0.1")
ODD = "doc_id bigint, text string, lang string, score string, p int"
ODD_ROWS = [(1, None, "en"), (2, "", "en"), (3, "123 $$", "fr"), (None, "Ein Satz und der", "de"), (4, "the thing and the " * 9_000, None), (4, "the", "en"), (4, "the", "en")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{BIG}/documents.parquet")


def odd(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ODD_ROWS], ODD)


def test_folds_are_those_of_crc32(spark):
    got = spark.range(200).select(F.col("id").alias("doc_id")).select("doc_id", language.held_out(3, 1).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_language_of_held_out_documents(docs):
    rows = language.predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) > 0.97 * len(rows)
    assert sum(r.rejected for r in rows) < 0.02 * len(rows) and all(0 <= r.score <= 1 for r in rows)


def test_language_needs_only_text(docs):
    blind = docs.withColumn("lang", F.when(~language.held_out(3, 1), F.col("lang"))).withColumn("source", F.lit("?"))
    one, two = (sorted(map(tuple, language.predictions(d).collect())) for d in (docs, blind))
    assert one == two


def test_language_of_odd_rows(spark):
    rows = language.predictions(odd(spark)).collect()
    assert len(rows) == len(ODD_ROWS)
    assert all(r.lang_pred == "und" and r.score == 0 and r.rejected for r in rows if r.doc_id in (1, 2, 3))
    empty = odd(spark).limit(0)
    assert language.predictions(empty).count() == 0 and language.drop_rejected(empty).columns == empty.columns
    assert language.predictions(odd(spark).withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def test_quality_of_held_out_documents(spark, docs):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    rows = quality.scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)
    assert quality.scores(docs, labels.limit(0)).where("score between 0.3 and 0.7").count() == docs.count()


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (4, 0), (None, 1), (2, None), (4, 1), (77, 0)], "doc_id bigint, quality int")
    rows = quality.scores(odd(spark), labels).collect()
    assert len(rows) == len(ODD_ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert quality.scores(odd(spark).limit(0), labels).count() == 0


def plain_buckets(text):
    """Buckets of a text by plain loops over its characters."""
    found = []
    own = (text or "").split()
    found += [quality.SAME for one, two in zip(own, own[1:]) if one == two]
    for word in own:
        found.append(zlib.crc32(word.encode()) % quality.BUCKETS)
        marked = f"<{word}>"
        for n in quality.GRAMS:
            for at in range(len(marked) - n + 1):
                h = n
                for c in marked[at:at + n]:
                    h = ((h ^ ord(c)) * 0x9E3779B97F4A7C15) % 2**64
                    h ^= h >> 29
                found.append(h % quality.BUCKETS)
    return found


def test_scores_are_those_of_plain_loops(monkeypatch):
    weights = quality.np.random.default_rng(0).normal(size=quality.BUCKETS)
    texts = ["a b b  c", "", "b", None, " \n", "b b b", "längere Wörter und 日本語の文字列 " * 3, "x" * 500 + " yz", "no blank" * 90]
    for places, most in ((1 << 16, 1_000_000), (7, 20), (64, 3)):
        monkeypatch.setattr(quality, "PLACES", places)
        monkeypatch.setattr(quality, "words_of", lambda t, most=most, own=quality.words_of: own(t, most)) if most < 100 else None
        scorer = quality.Scorer(weights, 0.25)
        for _ in range(2):
            for text, score in zip(texts, scorer.score(texts)):
                own = plain_buckets(text)
                raw = sum(weights[b] for b in own) / max(1, len(own)) + 0.25
                assert abs(score - 1 / (1 + quality.np.exp(-raw))) < 1e-9
                ids, shares = quality.features(text)
                assert sorted(ids) == sorted(set(own)) and all(abs(s - own.count(i) / len(own)) < 1e-6 for i, s in zip(ids, shares))
        monkeypatch.undo()


def test_a_score_does_not_depend_on_the_texts_beside_it():
    weights = quality.np.random.default_rng(1).normal(size=quality.BUCKETS)
    texts = [f"word{i} and more{i % 7} words " * (1 + i % 5) for i in range(200)]
    alone = [quality.Scorer(weights, 0.0).score([t])[0] for t in texts]
    assert list(quality.Scorer(weights, 0.0).score(texts[::-1]))[::-1] == alone


def test_memory_of_an_unspaced_text():
    code = """
import resource
from calzada.llm import quality
text = "".join(chr(0x4E00 + i * i % 5000) for i in range(7_000_000))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
quality.Scorer(quality.np.ones(quality.BUCKETS), 0.0).score([text, "x" * 20_000_000])
quality.features(text)
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""
    more = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert more < 500


def test_every_stage_does_its_work(spark, tmp_path):
    from calzada.llm import exact_dedup, mixing, simhash

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    docs.union(docs.limit(3)).withColumn("extra", F.lit(1)).write.parquet(f"{tmp_path}/in")
    now = spark.read.parquet(f"{tmp_path}/in")
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, SF_DIR)
        out.write.parquet(f"{tmp_path}/{n}")
        out = spark.read.parquet(f"{tmp_path}/{n}")
        before, after = [sorted(r.doc_id for r in d.select("doc_id").collect()) for d in (now, out)]
        if name == "language_id":
            gone = {r.doc_id for r in language.predictions(now).where("rejected").collect()}
            assert after == [i for i in before if i not in gone]
        elif name == "exact_dedup":
            assert after == sorted(r.keep_id for r in exact_dedup.exact_groups(now).where("kept").collect())
        elif name == "simhash_dedup":
            assert after == sorted({r.component_id for r in simhash.near_duplicates(now).collect()})
        elif name == "mixing":
            times = {r.doc_id: round(r.taken / r.size) for r in mixing.mix(now).collect() if r.size}
            assert abs(len(after) - sum(times.values())) <= 2
        else:
            assert after == before and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            texts = {r.doc_id: r.sha for r in now.select("doc_id", F.sha2("text", 256).alias("sha")).collect()}
            assert all(texts[r.doc_id] == r.decoded_sha256 for r in out.collect())
        if name != "byte_bpe":
            assert out.columns == now.columns
        now = out


def test_repeated_ids_are_learned_once(spark):
    rows = [(i, f"text number {i} of its own kind " * (3 + i % 5), "en" if i % 2 else "de") for i in range(60)]
    more = rows + [(i, text + f" again {n}", lang) for i, text, lang in rows[:4] for n in range(50)]
    one, two = (spark.createDataFrame(x, "doc_id bigint, text string, lang string") for x in (rows, more))
    assert language.excerpts(two, 256, 1_000).groupBy("lang", "doc_id").count().where("count > 1").isEmpty()
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(60)], "doc_id bigint, quality int")
    repeated = one.unionByName(one).unionByName(one)
    (a, bias), (b, other) = quality.learn(one, labels), quality.learn(repeated, labels)
    assert (a == b).all() and bias == other


def test_number_of_languages_is_bounded(spark):
    rows = [(i, f"text {i} of its kind", f"l{min(i % 40, i % 7)}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    often = sorted({r[2] for r in rows}, key=lambda x: (-sum(r[2] == x for r in rows), x))
    assert list(language.learn(docs, languages=3)) == often[:3] and set(language.learn(docs)) == set(often)


def test_language_by_compressed_sizes(spark):
    import zstandard

    docs = [(i, " ".join(words[(i * j + j) % len(words)] for j in range(5 + i % 60)), lang) for lang, words in
            (("en", "the of and to in a is that for it".split()), ("de", "der die und in den von zu das mit sich".split())) for i in range(60)]
    docs += [(900, "der und " * 5_000 + "the of and " * 100, None), (901, "Äpfel", None)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    learned = language.learn(df)
    got = {(r.text, r.lang) for r in df.select("text", language.language(df, learned).alias("p")).select("text", "p.lang").collect()}
    for _, text, _ in docs:
        sizes = {}
        for lang, raw in learned.items():
            own = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data, sizes[lang] = text.lower().encode(), 0
            while data:
                press = zstandard.ZstdCompressor(level=language.LEVEL, dict_data=own, write_checksum=False, write_content_size=False, write_dict_id=False)
                sizes[lang] += len(press.compress(data[:language.PIECE]))
                data = data[language.PIECE:]
        assert (text, min(sizes, key=sizes.get)) in got
