"""The pipeline against a brute-force version of its four stages, and what its stages return."""

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tests.llm.test_operators import crc, ids_of, jaccard_truth, removed, same
from vistaquery.llm import cascade


def documents():
    rnd = random.Random(11)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8)))
    vocabulary = [word() for _ in range(400)]
    text = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    passage, out = text(60), []
    for k in range(40):
        out.append(text(rnd.randint(55, 1500)))
        if k % 4 == 0:
            own = out[-1].split()
            own[3] = "changed"
            out += [" ".join(own), out[-1]]
        if k % 5 == 0:
            out.append(text(40) + "\n" + passage + "\n" + text(30))
    out += [passage, text(10), "x#$% " * 80, "same words again " * 40, None, "", "ABC " * 99]
    rnd.shuffle(out)
    return [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(out)]


def test_pipeline(spark, tmp_path):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = pipeline.run(spark, str(tmp_path)).collect()

    kept = [r for r in rows if not any(x.rejects(cascade.Measures(r[1])) for x in cascade.RULES)]
    stage = pipeline.quality(spark, docs, "")
    assert stage.columns == docs.columns
    same(stage.collect(), kept)
    truth, _ = jaccard_truth([r[:2] for r in kept], 5, 80)
    first = [r for r, (i, _, c) in zip(kept, truth) if i == c]
    stage = pipeline.near_duplicates(spark, stage, "")
    assert stage.columns == docs.columns and len(first) < len(kept)
    same(stage.collect(), first)
    texts = {r[0]: r for r in first}
    left = []
    for i, n, gone, joined in removed([r[:2] for r in first], pipeline.PASSAGE):
        r = texts[i]
        if gone < n or not gone:
            left.append((i, joined if gone else r[1], *r[2:4], len(joined) if gone else r[4]))
    stage = pipeline.repeated_passages(spark, stage, "")
    assert stage.columns == docs.columns and any(a != b for a, b in zip(sorted(left), sorted(first)))
    same(stage.collect(), left)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, total = [], 0
    for r in left:
        ids = ids_of(tokenizer, r[1])
        total += len(ids)
        head = len(ids) - 1024 * (-(-len(ids) // 1024) - 1)
        cuts = [0, *range(head, len(ids) + 1, 1024)]
        want += [(r[0], k, a, b - a, crc(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    same([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got], want)
    places = sorted((r.sequence_id, r.offset, r.length) for r in got)
    ends = {}
    for s, offset, n in places:
        assert offset == ends.get(s, 0)
        ends[s] = offset + n
    assert max(ends.values()) <= 1024 and len(ends) <= np.ceil(total / 1024) * 1.1 + 1


def test_stages_take_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in pipeline.STAGES:
        assert stage(spark, docs, "").count() == 0


CLASHING = "doc_id long, text string, kept int, rejected_by long, n_words string, n_removed string, part int, sig long, ord string, carried_columns string, n_chars int, `a b` long"


def test_further_columns_and_calls_side_by_side(spark):
    """Clashing names pass unchanged, null and repeated doc_ids and a text of 5 MB are rows like others, and one call leaves another's rows alone."""
    rnd = random.Random(3)
    text = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(n))
    long, passage = text(800_000), text(60)
    assert len(long) > 5_000_000
    texts = [(k, text(100)) for k in range(12)] + [(5, text(90)), (None, text(80)), (None, text(70)), (20, long), (21, f"{text(60)} {passage}"), (22, f"{text(60)} {passage}")]
    texts += [(30, texts[3][1]), (31, "few words"), (32, None)]
    row = lambda k, t: (k, t, 7, -1, "own", "mine", 3, 4, "o", "c", len(t or ""), 9)
    docs = spark.createDataFrame([row(k, t) for k, t in texts], CLASHING).repartition(3)
    kept = [(k, t) for k, t in texts if k not in (31, 32)]
    first = pipeline.quality(spark, docs, "")
    assert first.schema == docs.schema
    same(first.collect(), [row(*r) for r in kept])
    one, two = pipeline.near_duplicates(spark, first, ""), pipeline.near_duplicates(spark, first.where("doc_id < 10"), "")
    assert one.schema == docs.schema
    once = [r for r in kept if r[0] != 30]
    same(one.collect(), [row(*r) for r in once])
    same(two.collect(), [row(*r) for r in once if r[0] is not None and r[0] < 10])
    again, other = pipeline.repeated_passages(spark, one, ""), pipeline.repeated_passages(spark, two, "")
    assert again.schema == docs.schema
    short = " ".join(texts[17][1].split()[:60])
    same(again.collect(), [row(k, short if k == 22 else t) for k, t in once])
    same(other.collect(), two.collect())
    assert pipeline.sequences(spark, again, "").agg({"length": "sum"}).first()[0] > 100_000
    same(one.collect(), [row(*r) for r in once])
