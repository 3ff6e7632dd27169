"""The pipeline against a plain version of every stage."""

import collections
import hashlib
import re

import sentencepiece

import corpus_pipeline
from gaplens.llm import classifier, mixing, sentencepieces

from .test_simhash import brute_components, brute_fingerprint


def plain(docs, model):
    packers = model.packers()
    docs = [d for d in docs if classifier.chance(d["text"].encode(), model, packers) >= 0.3]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for d in docs:
        for line in d["text"].split("\n"):
            holders.setdefault(key(line), set()).add(d["doc_id"])
    for d in docs:
        keep = [x for x in d["text"].split("\n") if len(key(x)) < 20 or len(holders[key(x)]) < 3 or max(holders[key(x)]) == d["doc_id"]]
        d["text"] = "\n".join(keep)
    comps = brute_components([(d["doc_id"], brute_fingerprint(d["text"])) for d in docs])
    docs = [d for d, c in zip(docs, comps) if d["doc_id"] == c]

    terms = [re.findall(mixing.TERM, re.sub("[A-Z]", lambda m: m[0].lower(), d["text"])) for d in docs]
    held = collections.Counter(t for x in terms for t in set(x))
    names = sorted((t for t in held if 5 * held[t] <= len(docs)), key=lambda t: (-held[t], t.encode()))[: mixing.TOPICS]

    def topic(found):
        n = [(found.count(name), k, name) for k, name in enumerate(names)]
        return "=" + (max(n)[2] if n and max(n)[0] else "other")

    cells = {}
    for d, found in zip(docs, terms):
        d["cell"] = ("=" + d["source"], "=" + d["lang"], topic(found))
        d["tokens"] = len(re.findall(r"[^\x20\x09-\x0D]+", d["text"]))
        cells[d["cell"]] = cells.get(d["cell"], 0) + d["tokens"]
    raked = mixing.rake([dict(zip(mixing.DIMS, c), tokens=t) for c, t in cells.items()], mixing.TARGETS)
    scale = mixing.chances([(c["weight"] / c["tokens"], c["tokens"]) for c in raked if c["tokens"]], mixing.FRACTION)
    p = {tuple(c[d] for d in mixing.DIMS): round(mixing._chance(c, scale, mixing.FRACTION), 9) for c in raked}
    docs = [d for d in docs if int(hashlib.md5(str(d["doc_id"]).encode()).hexdigest()[:13], 16) / 2**52 < p[d["cell"]]]
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    return {d["doc_id"]: sp.encode(d["text"], num_threads=1) for d in docs}


def test_pipeline_equals_plain_version(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    model = classifier.fit(docs, spark.read.parquet(f"{d}/labels.parquet"))
    want = plain([r.asDict() for r in docs.collect()], model)
    out = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id: list(r.ids) for r in out} == want
    assert len(out) == len(want) > 20 and all(r.parity and r.exact for r in out)


def test_stages_keep_columns_and_take_edge_cases(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (3, "a b c", "en", None, None), (3, "a b c", "en", None, None), (None, "alone in here", "de", "t", 13), (6, "x " * 50_000, "en", "s", 100_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, frame, "/root/testdata/sf0.001")
            assert out.columns == docs.columns, name
            assert out.count() <= len(rows)
        assert corpus_pipeline.encode(spark, frame, "").count() == frame.count()
    kept = sorted(corpus_pipeline.near_dedup(spark, docs, "").select("doc_id").collect(), key=str)
    assert [r.doc_id for r in kept] == [1, 3, 6, None]
