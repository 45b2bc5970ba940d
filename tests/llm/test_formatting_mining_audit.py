"""Chat formatting, hard negatives and the filter audit against plain Python, on planted and odd input."""

import hashlib
import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from helioframe.llm import chat_format, filter_audit, hard_negatives

SAY = ["</s>", "<~/s>", "[INST]", "[~~INST]", "[/INST]", "[ROLE:x]", "[/ROLE]", "[image:3]", "[text:1]", "<<s>", "[", "<", "~", "ok", " ", "\n", "é😀", ""]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def turns(spark):
    rng = random.Random(11)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "to]ol ü+%", "Assistant"]), "".join(rng.choice(SAY) for _ in range(rng.randrange(9)))) for c in range(40) for t in range(rng.randrange(1, 9))]
    rows += [(50, 0, None, None), (50, None, "user", "first"), (None, 3, "assistant", "b"), (None, 1, "user", "a"), (51, 1, "assistant", "same"), (51, 1, "assistant", "same"), (51, 1, "user", "[IN"), (52, 0, "assistant", "long </s>" * 300_000)]
    rows += [(60, t, "assistant" if t % 2 else "user", f"turn {t} [INST]") for t in range(6000)]
    rng.shuffle(rows)
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, chunk string, g int")


def plain_turns(turns):
    found = {}
    for r in turns.collect():
        found.setdefault(r["conv_id"], []).append(((r["turn"] is not None, r["turn"] or 0), r["role"] or "", r["text"] or ""))
    return {c: [(role, text) for _, role, text in sorted(said)] for c, said in found.items()}


def test_chat_reads_back(turns):
    want = {
        c: (len(said), sha("".join(f"{r}\n{t}\n" for r, t in said)), len(learnt := "".join(t for r, t in said if r == "assistant")), sha(learnt))
        for c, said in plain_turns(turns).items()
    }
    got = {r["conv_id"]: r for r in chat_format.report(turns.repartition(7)).collect()}
    assert {c: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for c, r in got.items()} == want
    chunks = chat_format.format_chat(turns).collect()
    sizes = {}
    for r in chunks:
        sizes[r["conv_id"]] = sizes.get(r["conv_id"], 0) + len(r["text"])
        assert r["n_turns"] <= chat_format.CHUNK_TURNS and (len(r["text"]) <= chat_format.CHUNK_CHARS or r["n_turns"] == 1)
        plain = re.sub(r"\[INST\] | \[/INST\]|</s>|\[ROLE:[^\]]*\]|\[/ROLE\]", "", r["text"])
        assert not re.search(r"</?s>|\[/?INST\]|\[ROLE:|\[/ROLE\]|\[(image|text):", plain)
    assert sizes == {c: r["formatted_chars"] for c, r in got.items()}
    assert sum(r["conv_id"] == 60 for r in chunks) > 1  # a long conversation has several chunks


def test_chat_of_nothing_and_probe(turns, spark):
    assert chat_format.report(turns.limit(0)).count() == 0
    only = chat_format.report(chat_format.with_probe(turns.limit(0))).collect()
    said = "</s>[INST] ok [/INST]"
    assert [(r["conv_id"], r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in only] == [(-1, 2, sha(f"user\n{said}\nassistant\n{said}\n"), 21, sha(said))]
    with pytest.raises(ValueError):
        list(chat_format.turns_of("[INST] a [/INST]stray"))


def test_typed_parts(spark):
    part = lambda kind, **k: tuple(k.get(c) if c != "type" else kind for c in ("type", "text", "ref", "width", "height", "seconds", "pages"))
    rows = [
        (1, 0, "user", [part("text", text="look "), part("image", ref="a.png", width=57, height=28), part("text", text="[IN"), part("text", text="ST] <"), part("audio", ref="b.wav", seconds=1.5)]),
        (1, 1, "assistant", [part("document", ref="c.pdf", pages=3), part("text", text="seen</s>"), part("text", text="")]),
        (1, 2, "user", [None, part("image", ref=None), part("video", text="odd [image:0]")]),
        (1, 3, "assistant", None), (1, 4, "user", []),
    ]
    chunks = chat_format.format_chat(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat_format.PARTS}"), parts="parts")
    (r,) = chunks.collect()
    assert r["text"] == "[INST] look [image:1][text:2][IN[text:3]ST] <[audio:4] [/INST] [document:0][text:1]seen<~/s>[text:2]</s>[INST] [image:0][text:1]odd [~image:0] [/INST] </s>[INST]  [/INST]"
    assert [(a["turn"], a["part"], a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [(0, 1, "image", "a.png", 3), (0, 4, "audio", "b.wav", 38), (1, 0, "document", "c.pdf", 768), (2, 0, "image", None, 0)]
    assert all(r["text"].startswith(f"[{a['type']}:{a['part']}]", a["at"]) for a in r["attachments"]) and r["media_tokens"] == 809
    (back,) = chat_format.read_back(chunks).collect()
    assert [[(p["type"], p["text"]) for p in t["parts"]] for t in back["turns"]] == [
        [("text", "look "), ("image", ""), ("text", "[IN"), ("text", "ST] <"), ("audio", "")], [("document", ""), ("text", "seen</s>"), ("text", "")],
        [("image", ""), ("text", "odd [image:0]")], [("text", "")], [("text", "")],
    ]
    assert back["learnt"] == ["seen</s>", ""]


def mined(rows, is_anchor):
    best = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (str(label), [math.floor(256 * x) for x in v])
        best[i] = min(best.get(i, row), row)
    found = set()
    for a, (label, v) in best.items():
        if not is_anchor(a):
            continue
        scores = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, (other, w) in best.items() if i != a)
        for p, i, _ in [s for s in scores if s[2] == label][:5]:
            fits = [(s, j) for s, j, other in scores if other != label and 80 * -p <= 100 * -s <= 100 * -p]
            found |= {(a, i, n, j, -p, -s) for n, (s, j) in enumerate(fits[:5], 1)}
    return found


@pytest.mark.parametrize("blocks", [(2048, 256, 32), (7, 3, 4)])
def test_hard_negatives(spark, monkeypatch, blocks):
    for name, value in zip(("ROWS_PER_BLOCK", "ANCHORS_PER_BLOCK", "CHUNK"), blocks):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = random.Random(12)
    base = [[rng.choice([-0.25, 0.0, 0.1, 0.5, 0.4]) for _ in range(10)] for _ in range(12)]
    rows = [(i, [x + rng.choice([0.0, 0.0, 0.01]) for x in rng.choice(base)], rng.choice([0, 0, 0, 1, 2])) for i in range(150)]
    rows += [(200, [0.5] * 3, 1), (201, [], 1), (202, None, 0), (203, [0.1, None], 0), (204, [float("nan")], 0), (205, [float("inf")], 0), (206, [0.3] * 10, None), (None, [0.3] * 10, 0)]
    rows += [(210, [0.5] * 25, 0), (210, [0.5] * 25, 0), (210, [0.4] * 25, 0), (211, [0.5] * 10, 7)]
    table = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, embedding array<float>, label int, r string, a int").repartition(5)
    got = hard_negatives.mine(table, F.col("vec_id") % 10 == 0).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == mined([(i, v and [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows], lambda i: i % 10 == 0)
    assert len(got) > 100
    assert hard_negatives.mine(table.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(table, F.col("vec_id") < 0).count() == 0


def test_blocks_are_never_broadcast(spark):
    rows = [(i, [0.5 + i % 3] * 64, i % 4) for i in range(3000)]  # small in a file, large in memory
    found = hard_negatives.mine(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), F.col("vec_id") % 10 == 0)
    assert found.count() == 300 * 25
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_product_is_exact():
    big = np.array([[2**40 + 1, 3]], dtype=np.int64)
    assert hard_negatives.product(big, big)[0, 0] == (2**40 + 1) ** 2 + 9 - 2**64 * round(((2**40 + 1) ** 2 + 9) / 2**64)  # wraps, as documented
    small = np.array([[2**20 + 1, -3]], dtype=np.int64)
    assert hard_negatives.product(small, small)[0, 0] == (2**20 + 1) ** 2 + 9


def test_filter_audit(spark):
    rng = random.Random(13)
    words = "the of and Solar ROOF panel grid south".split()
    texts = [" ".join(rng.choice(words) for _ in range(n)) + rng.choice(["", "#", " $5"]) for n in (1, 5, 30, 199, 200, 260, 400) for _ in range(6)]
    texts += [" \t\n".join(f"w{i}" for i in range(250)), "é" * 50 + "A", "x y", "|"]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(300)]
    rows += [(400, None, "en"), (401, "", "de"), (402, " ", None), (None, texts[0], "en"), (None, None, "en"), (7, texts[1], "de"), (7, texts[1], "de"), (403, "word " * 100_000, "nl")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 300, 2)] + [(7, 1, 1), (7, 0, 0), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, "s", 9) for r in rows], "doc_id long, text string, lang string, part string, n int").repartition(6)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    least, good, toxic = {}, {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)

    def failed(i, t):
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        return {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and i > least[t],
        }

    facts = [(lang or "", failed(i, t or ""), i in good, i in toxic) for i, t, lang in rows]
    want = {}
    for part in {f[0] for f in facts}:
        own, value = [f for f in facts if f[0] == part], dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                out, left = [x for x in left if x[1][f]], [x for x in left if not x[1][f]]
                value[f] += len(out)
                want[part, "".join(order), step] = [len(left), len(out), sum(x[1][f] for x in own) - len(out), sum(x[1][f] and sum(x[1].values()) == 1 for x in own), sum(x[2] for x in out), sum(x[3] for x in out), f]
        for k, v in want.items():
            if k[0] == part:
                v[-1] = value[v[-1]]
    got = filter_audit.audit_documents(docs, marks)
    assert {(r["part"], r["filter_order"], r["step"]): list(r)[3:] for r in got.collect()} == want
    assert filter_audit.audit_documents(docs.limit(0), marks).count() == 0
    bare = filter_audit.audit_documents(docs, marks.limit(0)).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(bare) == (0, 0)
    with pytest.raises(ValueError):
        filter_audit.audit(docs, ["A", "A"], {"rows": F.lit(1)})
