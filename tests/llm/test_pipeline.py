import hashlib
import random
import re

import corpus_pipeline
import __spark_entry__
from helioframe.llm import byte_bpe, quality

from .test_operators import brute_components, brute_hits, prose, shingles


def test_pipeline_runs_its_stages_in_order(spark, tmp_path, monkeypatch):
    rng = random.Random(12)
    texts = [prose(rng, rng.randint(20, 60)) for _ in range(160)]
    passage = prose(rng, 16)
    for i in range(160, 200):  # exact copies, white-space copies, near copies, leaks
        words = texts[i - 160].split()
        if i % 4 == 2:
            words[-1] = "changed"
        if i % 4 == 3:
            words[5:5] = passage.split()
        texts.append(("\n" if i % 4 == 1 else " ").join(words))
    texts = [re.sub(r"\S+", r"\g<0>###", t) if i % 5 == 0 else t for i, t in enumerate(texts)]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    items = [(1, passage), (2, prose(rng, 12))]
    path = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(200)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")

    stages = []
    keep = corpus_pipeline.written

    def watched(df, name):
        out = keep(df, name)
        stages.append((name, out))
        return out

    monkeypatch.setattr(corpus_pipeline, "written", watched)
    final = {r["doc_id"]: r for r in __spark_entry__.queries()["pipeline"](spark, path).collect()}
    assert [n for n, _ in stages] == ["quality", "exact_dedup", "near_dedup", "decontamination"] == [n for n, _ in corpus_pipeline.STAGES[:-1]]
    got = {n: {tuple(r) for r in out.collect()} for n, out in stages}

    # quality has no brute-force version: it is held against its scores, and against what was planted
    scored = {r["doc_id"] for r in quality.classify(spark.read.parquet(f"{path}/documents.parquet"), labels).where("predicted = 1").collect()}
    have = {r for r in rows if r[0] in scored}
    assert got["quality"] == have and len(scored ^ {i for i in range(200) if i % 5}) <= 6

    first = {}
    for r in sorted(have):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1]), r)
    assert got["exact_dedup"] == set(first.values()) and len(first) < len(have)
    have = set(first.values())

    leaders = set(brute_components({r[0]: shingles(r[1]) for r in have}).values())
    assert got["near_dedup"] == {r for r in have if r[0] in leaders} and len(leaders) < len(have)
    have = got["near_dedup"]

    clean = {r for r in have if not brute_hits(r[1], items)[1]}
    assert got["decontamination"] == clean and len(clean) < len(have)

    import public_tokenizers
    import tiktoken

    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    assert final.keys() == {r[0] for r in clean}
    for i, text, *_ in clean:
        ids = library.encode_ordinary(text)
        assert (final[i]["n_tokens"], final[i]["ids_sha256"], final[i]["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
