"""Each operator against a brute-force version, and on nulls, empty and long texts, ties and odd columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest

from helioframe.llm import byte_bpe, decontamination, exact_dedup, html_extract, language_id, ngram_join, pii, quality, toxicity, warc
from helioframe.llm.shared import components

ASCII_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
WORDS = "the of and energy roof panel solar module wire cable site grid south north sun".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", ",", "."]) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    base = [prose(rng, rng.randint(1, 80)) for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(base)]
    for i in range(60, 140):  # exact, white-space and near copies
        words = base[i % 20].split()
        if i % 3 == 1:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, (" " if i % 3 else "\t\n").join(words)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "one"), (204, "ONE"), (205, "x" * 5000 + " y" * 3000), (206, "日本語 é 😀"), (207, base[0])]
    return spark.createDataFrame([(i, t, "en", 7) for i, t in rows], "doc_id long, text string, x_id string, n long")


def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_exact_duplicates(docs, spark):
    groups = {}
    for i, t in texts(docs).items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), []).append(i)
    want = {i: (min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}
    for parts in (1, 13):
        got = exact_dedup.exact_duplicates(docs.repartition(parts)).collect()
        assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got} == want
    kept = exact_dedup.drop_duplicates(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b"), (4, "a  b"), (4, "a b"), (None, "z"), (7, "c")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.exact_duplicates(odd.repartition(5)).collect()), key=str)
    assert got == sorted([(None, 4, 3, False), (4, 4, 3, True), (4, 4, 3, True), (None, None, 1, False), (7, 7, 1, True)], key=str)


def test_runs_are_merged_in_order(docs):
    """Every round is an exchange by run and slot, a sort and a sort aggregate; nothing is hashed into memory."""
    from pyspark.sql import functions as F

    runs = exact_dedup.merged(exact_dedup.digest_runs(docs.repartition(13), "doc_id", "text"), F.col("d_id"), F.lit(1))
    plan = exact_dedup.merge_round(runs, 4)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" in plan and "HashAggregate" not in plan and "d_slot" in plan


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(ASCII_LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_components(sets):
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("block", [2048, 4])
def test_near_duplicates(docs, block, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    sets = {i: shingles(t) for i, t in texts(docs).items()}
    want = brute_components(sets)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(docs).collect()}
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    if block == 2048:
        kept = ngram_join.keep_one(docs)
        assert kept.columns == docs.columns and {r["doc_id"] for r in kept.select("doc_id").collect()} == set(want.values())


def test_near_duplicates_of_nothing(docs):
    assert ngram_join.near_duplicates(docs.limit(0)).count() == 0


def test_tree_finds_all_pairs_that_bounds_allow():
    import numpy as np

    rng = np.random.default_rng(1)
    points = rng.integers(0, 9, (300, ngram_join.GROUPS)).astype(np.int32)
    points[100:200] = np.maximum(points[:100] + rng.integers(-1, 2, (100, ngram_join.GROUPS)), 0)
    points = points[np.argsort(points.sum(1), kind="stable")]
    n = points.sum(1)
    bound = np.minimum(points[:, None], points[None]).sum(2)
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if ngram_join.enough(bound[i, j], n[i], n[j])}
    tree = ngram_join.Tree(points, n)
    assert set(zip(*(x.tolist() for x in tree.pairs(tree, True)))) == want
    left, right = np.arange(0, 300, 2), np.arange(1, 300, 2)
    i, j = ngram_join.Tree(points[left], n[left]).pairs(ngram_join.Tree(points[right], n[right]), False)
    assert {tuple(sorted(p)) for p in zip(left[i].tolist(), right[j].tolist())} == {p for p in want if (p[0] + p[1]) % 2}


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (7, 7), (3, None)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 31)} | {100: 50, 70: 50}


def brute_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words, hit, found = word.findall(text.translate(ASCII_LOWER)), set(), set()
    for item, phrase in items:
        w = word.findall((phrase or "").translate(ASCII_LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            p = w[k : k + 10]
            for at in range(len(words) - len(p) + 1):
                if words[at : at + len(p)] == p:
                    hit |= set(range(at, at + len(p)))
                    found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_decontamination_of_repeated_and_null_rows(spark, most):
    """Documents with one identifier, or none, and different texts; items without identifier; with one pass and several."""
    rng = random.Random(1)
    items = [(k, prose(rng, 14)) for k in range(6)] + [(None, prose(rng, 12)), (2, prose(rng, 11))]
    rows = [(5, f"a {items[0][1]} b {items[1][1]} {items[6][1]}"), (5, f"{items[2][1]} c"), (5, "clean words"), (None, items[7][1]), (None, None), (8, items[3][1] + " " + items[3][1])]
    got = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), max_phrases=most).collect()
    want = sorted(((i, *brute_hits(t or "", [("" if k is None else k, x) for k, x in items])[:2], hashlib.sha256(",".join(brute_hits(t or "", [("" if k is None else k, x) for k, x in items])[2]).encode()).hexdigest()) for i, t in rows), key=str)
    assert sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items_sha256"]) for r in got), key=str) == want
    assert {len(r["spans"]) for r in got if r["doc_id"] == 8} == {1} and sum(r["contaminated"] for r in got) == 4


@pytest.mark.parametrize("most", [1_000_000, 10])
def test_decontamination(docs, spark, most):
    rng = random.Random(9)
    t = texts(docs)
    items = [(1, " ".join(t[3].split()[:14]) + "!"), (2, "one"), (3, None), (4, ""), (5, prose(rng, 30)), (10, " ".join(t[3].split()[5:25])), (11, "日本語"), (12, "one")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = {i: brute_hits(x, items) for i, x in t.items()}
    got = {r["doc_id"]: r for r in decontamination.decontaminate(docs, bench, max_phrases=most).collect()}
    for i, (n, hit, found) in want.items():
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) == (n, hit, len(found), hit > 0)
        assert r["items_sha256"] == hashlib.sha256(",".join(found).encode()).hexdigest()
    clean = decontamination.keep_clean(docs, bench, max_phrases=most)
    assert clean.columns == docs.columns and {r[0] for r in clean.select("doc_id").collect()} == {i for i, w in want.items() if not w[1]}
    cut = texts(decontamination.remove_spans(docs, decontamination.decontaminate(docs, bench)))
    assert "one" not in cut[203] and cut[205] == t[205]
    assert decontamination.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0


def test_suffix_order_is_the_order_of_suffixes():
    import numpy as np

    rng = np.random.default_rng(3)
    text = np.concatenate((rng.integers(1, 4, 200), [0], np.tile([1, 2], 40), [0]))
    order = decontamination.suffix_order(text).tolist()
    gaps = np.flatnonzero(text == 0).tolist()
    key = [(gaps.index(k) - len(gaps)) if v == 0 else int(v) for k, v in enumerate(text.tolist())]
    assert order == sorted(range(len(key)), key=lambda k: key[k:])


def test_warc(spark):
    big = "<p>" + "é" * 800
    rows = [(1, "http://a/", big), (2, "http://b/", big), (3, None, big + "x"), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", ""), (9, "u", big)]
    pages = spark.createDataFrame([r + (0,) for r in rows], "page_id long, url string, html string, header int")
    from helioframe.llm.shared import shared_dir

    folder = shared_dir(spark) + "/warc-test"
    warc.write_archive(pages, folder)
    got = {r["page_id"]: r for r in warc.read_archive(spark, folder).collect()}
    assert set(got) == {r[0] for r in rows}
    for i, url, html in rows:
        data = (html or "").encode()
        assert bytes(got[i]["payload"]) == data and got[i]["sha1"] == hashlib.sha1(data).hexdigest() and got[i]["length"] == len(data) and got[i]["url"] == url
    assert {i: (r["record_type"], r["refers_to"]) for i, r in got.items() if r["record_type"] == "revisit"} == {1: ("revisit", 9), 2: ("revisit", 9)}
    assert spark.read.parquet(folder + "/payloads").count() == 4
    record = bytes(got[9]["record"])
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(big.encode() + b"\r\n\r\n")
    assert bytes(got[1]["record"]).endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    report = {r["page_id"]: r for r in warc.report(warc.read_archive(spark, folder)).collect()}
    assert {i: (report[i]["payload_bytes"], report[i]["payload_digest"]) for i in got} == {i: (len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows}


@pytest.mark.parametrize("most", [4096, 1])
def test_warc_of_repeated_null_and_text_identifiers(spark, most, monkeypatch):
    from helioframe.llm.shared import shared_dir

    monkeypatch.setattr(warc, "PART_RECORDS", most)
    big = "x" * 1000
    for k, kind in enumerate(("long", "string")):
        of = (lambda x: x) if kind == "long" else (lambda x: x and f"p{x}")
        rows = [(of(1), "u", big), (of(1), "u", big), (None, "", big), (of(3), "u", big), (of(3), "u", big), (None, "a\r\nX-Page-ID: 8", "y" * 1001), (None, None, "y" * 1001)]
        folder = f"{shared_dir(spark)}/warc-odd-{most}-{k}"
        warc.write_archive(spark.createDataFrame(rows, f"page_id {kind}, url string, html string"), folder)
        archive = warc.read_archive(spark, folder)
        got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.report(archive).collect()), key=str)
        want = [(of(1), "revisit", of(3), 1000)] * 2 + [(None, "revisit", of(3), 1000)] + [(of(3), "response", None, 1000)] * 2 + [(None, "response", None, 1001)] * 2
        assert got == sorted(want, key=str) and spark.read.parquet(folder + "/payloads").count() == 2
        assert sorted((r["url"] for r in archive.collect()), key=str) == sorted(["u"] * 4 + ["", "a\r\nX-Page-ID: 8", None], key=str)


HARD = ["it's  don't 'street ''s 's x's\n\n y  \n z", "", "   ", "a   ", "\n", "  \n\n  x", " 123 abc ½ x y 　z", "I'll I'LL we've 're' 'v 've", "a\t b\t\tc", " 's x!'s", "z" * 300, "é" * 150 + "!" * 200, "𝔘 日本語 ١٢٣ ", "'", "'d", "'l", "a'l", None]


@pytest.mark.parametrize("most", [400_000, 3])
def test_byte_bpe(spark, docs, most, monkeypatch):
    import public_tokenizers
    import tiktoken

    monkeypatch.setattr(byte_bpe, "MAX_WORDS", most)
    monkeypatch.setattr(byte_bpe, "BLOCK_BYTES", 600)
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rows = spark.createDataFrame(list(enumerate(HARD, 1000)), "doc_id long, text string").unionByName(docs.select("doc_id", "text")).coalesce(1)
    plain = {r["doc_id"]: r["text"] or "" for r in rows.collect()}
    want = {i: library.encode_ordinary(t) for i, t in plain.items()}
    encoded = byte_bpe.encode(rows, path)
    if most > 3:
        got = byte_bpe.decode(encoded, path).collect()
        assert {r["doc_id"]: list(r["ids"]) for r in got} == want
        assert all(bytes(r["text_bytes"]) == plain[r["doc_id"]].encode() for r in got)
    for r in byte_bpe.encode(rows, path, digests=True).collect():
        ids = want[r["doc_id"]]
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(plain[r["doc_id"]].encode()).hexdigest())


def test_byte_bpe_tells_very_long_words_apart(spark):
    """Two words of more than 64 KiB that swap bytes 65,536 apart; in one task, and through the joins on words."""
    import public_tokenizers
    import tiktoken

    rng = random.Random(5)
    one = "".join(rng.choice("abcdefgh") for _ in range(70_000))
    one = "a" + one[1:65_536] + "b" + one[65_537:]
    two = "b" + one[1:65_536] + "a" + one[65_537:]
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rows = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string").coalesce(1)
    for r in byte_bpe.encode(rows, path, digests=True).collect():
        text = (one, two)[r["doc_id"] - 1]
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, library.encode_ordinary(text))).encode()).hexdigest()
    assert [r["component_id"] for r in ngram_join.near_duplicates(rows).orderBy("doc_id").collect()] == [1, 2]
    bench = spark.createDataFrame([(9, two)], "item_id long, text string")
    assert [r["n_hit"] for r in decontamination.decontaminate(rows, bench).orderBy("doc_id").collect()] == [0, 1]


def test_ranks_above_16_bits_have_their_own_keys():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 70_000, b"cd": 4_464, b"abcd": 131_000}
    assert byte_bpe.merges(ranks) == {97 << 32 | 98: 70_000, 99 << 32 | 100: 4_464, 70_000 << 32 | 4_464: 131_000}
    base, table, bits = byte_bpe.rank_table(ranks)
    assert bits == 17 and table[base[70_000] + 4_464] == 70_000 << bits | 131_000
    with pytest.raises(ValueError):
        byte_bpe.rank_table(ranks | {b"zz": 1 << 22})


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        luhn = sum(d * (1 + k % 2) - 9 * (d * (1 + k % 2) > 9) for k, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and luhn % 10 == 0
    return kind != "phone" or 8 <= len(digits) <= 15


def test_pii(spark):
    rng = random.Random(2)
    rows = ["a@b.c_x@y.z.", "é😀 x@y.z 1.2.3.4.5 999.1.1.1 01.002.3.4", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111-4", "+1 (988) 555-2485, +12 +1234567 +1.2", "", None, "7" * 5000, "1 2 " * 3000, "a" * 20000 + "@b.c", "a@b@c.d"]
    rows += ["".join(rng.choice("a1+@. -(4") for _ in range(60)) for _ in range(200)]
    # a context that always goes with addresses discovers one in another form
    rows += [f"please write to user{k}@mail.example.com now" for k in range(8)] + ["please write to someone[at]mail.example now"]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    for i, t in enumerate(rows):
        want = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, t or "") if passes(k, m[0])]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest(), t
        assert Counter(k for k, _, _ in want) == Counter({k: n for k in PLAIN if (n := got[i][f"n_{k}"])})
    last = len(rows) - 1
    assert got[last]["spans"] == "email:16:39" and got[last]["n_discovered"] == 1
    assert pii.redact(docs).where(f"doc_id = {last - 1}").first()["text"] == "please write to <email> now"


def test_pii_discovers_in_generations_and_by_row(spark):
    """Seeds make patterns, what they find makes more; spaced and long instances, rows that repeat an identifier."""
    rows = [f"please call +1 (988) 555-{1000 + k} thanks" for k in range(12)]
    rows += [f"please call (988) 555-{2000 + k} thanks" for k in range(6)]  # found by the seeds' words
    rows += [f"desk number (988) 555-{2000 + k} anytime" for k in range(6)] + ["desk number 988 555 7777 anytime"]  # by what those found
    rows += [f"log in as user{k}@mail.example.com today" for k in range(12)] + ["log in as " + "x" * 300 + "[at]mail.example.com today"]
    rows += [f"item number {k} only" for k in range(20)]
    docs = spark.createDataFrame([(k // 2, t) for k, t in enumerate(rows)], "doc_id long, text string")
    got = {(r["doc_id"], r["spans"]) for r in pii.report(docs).where("n_discovered > 0").collect()}
    want = set()
    for k, t in enumerate(rows):
        for kind, m in (("phone", re.search(r"(?<!\+1 )\(988\) 555-....|988 555 7777", t)), ("email", re.search(r"x+\[at\]\S+", t))):
            want |= {(k // 2, f"{kind}:{m.start()}:{m.end()}")} if m else set()
    assert got == want and len(want) == 8


def test_pii_of_long_texts_takes_time_in_proportion(spark):
    import time

    line = "host 10.1.{}.{} said code {} to user{}@mail.example.com at +1 (988) 555-{:04d}\n"
    text = "é" + "".join(line.format(k % 256, k // 256 % 256, k, k, k % 10000) for k in range(6_000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.time()
    r = pii.report(docs).first()
    assert (r["n_ip"], r["n_email"], r["n_phone"]) == (6_000, 6_000, 6_000) and time.time() - began < 120
    want = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text) if passes(k, m[0])]
    assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_html():
    page = "<body><nav>menu</nav><div class='post'><h1>T</h1><p>a &amp; b<br>c<p>d <script>x<y</script></div><div class='comments'><p>no</div><div id=sidebar>x</div><form>y</form><footer>z"
    blocks = html_extract.blocks(page)
    assert html_extract.text_in(blocks, html_extract.best_path(html_extract.container_scores(blocks))) == "T\n\na & b c\n\nd"
    assert html_extract.blocks("") == []


def test_html_attributes_are_read_one_by_one():
    def text(page):
        read = html_extract.blocks(page)
        return html_extract.text_in(read, html_extract.best_path(html_extract.container_scores(read)))

    for page in ("<div style='overflow:hidden'><p>Main</p></div>", "<article aria-hidden=\"false\">Main</article>", "<section title=\"hidden gems\"><p>Main</section>", "<div data-hidden=1 data-class='ad'>Main</div>", "<p title=it's>Main</p>", "<p title='a>b' id=x>Main</p>", "<p class=\"open>Main</p>", "<p>Ma<span class=ad>buy <span>now</span></span>in</p>", "<p>Main<span class='ad'>never closed</p>"):
        assert text(page) == "Main", page
    for page in ("<p hidden>no</p>", "<div aria-hidden='true'>no</div>", "<div HIDDEN=''>no</div>", "<div role=navigation>no</div>", "<div id='side-bar-3'>no</div>"):
        assert text(page) is None, page
    deep = "<div>" * 20_000 + "<p>in" + "</div>" * 20_000
    assert text(deep) == "in" and text("<li>" * 20_000 + "x") == "x"
    assert len(text("<p>" + "word " * 400_000)) == 5 * 400_000 - 1


def test_html_finds_planted_articles(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for k in range(60):
        parts = [prose(rng, rng.randint(3, 60)) + rng.choice([" & more", " <3", " “q”", ""]) for _ in range(rng.randint(1, 7))]
        escaped = [p.replace("&", "&amp;").replace("<", rng.choice(["&lt;", "&#60;"])).replace(" ", rng.choice([" ", "\n  "])) for p in parts]
        body = "".join(f"<p>{'<b>' + e + '</b>' if rng.random() < 0.3 else e}" + rng.choice(["</p>", ""]) for e in escaped)
        inside = rng.choice(["article", "div class='story-%d'" % k])
        rows.append((k, f"https://h{k % 3}.example/{k}", f"<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>{prose(rng, 9)}</a></ul></nav><!-- x --><{inside}>{body}<script>var a='</p>'</script></{inside.split()[0]}><div class='comments'><p>{prose(rng, 90)}</p></div><aside>{prose(rng, 20)}</aside><form><input><p>{prose(rng, 5)}</p></form><footer>&copy; {prose(rng, 30)}</footer></body></html>"))
        want[k] = "\n\n".join(parts)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert got == want


def test_html_consensus(spark):
    good = "<body><div class='c{k}'><p>{a}</p><p>{b}</p></div><div class='box'><p>{c}</p></div></body>"
    rows = [(k, "http://h.example/%d" % k, good.format(k=k, a="main " * 20, b="text " * 20, c="side")) for k in range(5)]
    rows += [(5, "http://h.example/5", good.format(k=5, a="short", b="one", c="long box " * 30)), (6, "http://h.example/6", None), (7, None, "<p>alone</p>")]
    got = {r["page_id"]: r["text"] for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5] == "short\n\none" and got[6] == "" and got[7] == "alone"
    assert got[0] == ("main " * 20).strip() + "\n\n" + ("text " * 20).strip()


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(600):
        bad, toxic = i % 4 == 0, i % 5 == 1
        words = prose(rng, rng.randint(20, 90)).split()
        if bad:
            words = [w + "###" for w in words]
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "m0ron", "idіot"]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(900, None, None), (901, "", "en")]
    labels.append((902, 1, 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def held(i, divisor, rest):
    return zlib.crc32(str(i).encode()) % divisor == rest


def test_quality(labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in quality.classify(docs, labels).collect()}
    assert len(got) == 602 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) and r["held_out"] == held(i, 4, 2) for i, r in got.items())
    tried = [i for i in range(600) if held(i, 4, 2)]
    assert sum(got[i]["predicted"] == int(i % 4 != 0) for i in tried) / len(tried) > 0.97
    kept = quality.keep_good(docs, labels)
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    assert quality.classify(docs, labels.limit(0)).select("score").distinct().count() == 1


def test_toxicity(labelled):
    docs, labels = labelled
    got = {r["doc_id"]: r for r in toxicity.classify(docs, labels).collect()}
    tried = [i for i in range(600) if held(i, 3, 1)]
    assert all(r["held_out"] == held(i, 3, 1) for i, r in got.items())
    assert sum(got[i]["predicted"] == int(i % 5 == 1) for i in tried) / len(tried) > 0.97
    assert got[900]["predicted"] == got[901]["predicted"] == 0
    lexicon = toxicity.Lexicon({toxicity.fold("trash"): 2.0}, {"low": 1.0}, ["trash can"])
    automaton = lexicon.automaton()
    assert [w for _, _, w in toxicity.matches(toxicity.fold("TR4SH in the trash can, lowly slow"), automaton)] == [2.0, 1.0]


def test_toxicity_signs_end_words_and_the_lexicon_is_whole(spark):
    automaton = toxicity.Lexicon({toxicity.fold("idiot"): 2.0}).automaton()
    found = {t: toxicity.measures(t, automaton)[0] for t in ("you idiot!", "IDI0T!!", "an idi\u200bot$ | x", "idiot!x", "idiots!", "idiot@home")}
    assert found == {"you idiot!": 2.0, "IDI0T!!": 2.0, "an idi\u200bot$ | x": 2.0, "idiot!x": 0.0, "idiots!": 0.0, "idiot@home": 0.0}
    assert {"ldlotl", "ldlot"} <= toxicity.terms_of("idiot!")
    excused = toxicity.Lexicon({toxicity.fold("trash"): 2.0}, exceptions=["trash can"]).automaton()
    assert toxicity.measures("into the trash can!", excused)[0] == 0.0
    words = [f"{a}{b}{c}q" for a in "cdfghkmnpr" for b in "cdfghkmnprtvwx" for c in "cdfghkmnprtvwxyqab"]
    docs = spark.createDataFrame([(i, " ".join(words) if i < 6 else "calm and plain words") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(200)], "doc_id long, toxic int")
    assert len(words) > 2000 and set(toxicity.fit(docs, labels).words) == {toxicity.fold(w) for w in words}


def test_toxicity_learns_exceptions_far_into_a_text_and_from_labels_of_two_kinds(spark):
    long = "b" * 100
    texts = [f"{'calm ' * 40}you vermin go" for _ in range(12)] + [f"{'calm ' * 40}{long} vermin control" for _ in range(6)] + ["calm plain words"] * 900
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i < 12 else (0 if i % 2 else 7) if i >= 18 else 0) for i in range(len(texts))], "doc_id long, toxic int")
    lexicon = toxicity.fit(rows, labels)
    assert {f"{toxicity.fold(long)} {toxicity.fold('vermin')}", toxicity.fold("vermin control")} == set(lexicon.exceptions)
    automaton = lexicon.automaton()
    assert toxicity.measures("the vermin", automaton)[0] > 0 and toxicity.measures("vermin control", automaton)[0] == 0
    none = toxicity.fit(rows, spark.createDataFrame([(1, 7), (2, None)], "doc_id long, toxic int"))
    assert not none.words and toxicity.score(rows, none).where("score > 0.01").count() == 0



def test_language(spark, monkeypatch):
    monkeypatch.setattr(language_id, "STEPS", 150)
    rng = random.Random(6)
    syllables = {"aa": ["the", "ing", "th", "ou", "er"], "bb": ["ção", "lha", "ão", "nha", "os"], "cc": ["sch", "ung", "ü", "ein", "tz"]}
    rows = []
    for i in range(300):
        lang = list(syllables)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang))
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !?", "aa"), (903, "schungtz" * 3000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in language_id.identify(docs).collect()}
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == ["und"] * 3 + ["cc"]
    assert all(0 <= r["score"] <= 1 and r["held_out"] == held(i, 4, 2) for i, r in got.items())
    tried = [i for i in range(300) if held(i, 4, 2)]
    assert sum(got[i]["lang_pred"] == list(syllables)[i % 3] for i in tried) / len(tried) > 0.95


def gru(net, d, symbols):
    """States of one direction, a step at a time."""
    import numpy as np

    h, state, out = net.h, np.zeros(net.h), []
    for c in symbols:
        gates, rec = net.w["x" + d][c], state @ net.w["u" + d]
        z, r = (1 / (1 + np.exp(-(gates[k : k + h] + rec[k : k + h]))) for k in (0, h))
        state = state + z * (np.tanh(gates[2 * h :] + r * rec[2 * h :]) - state)
        out.append(state)
    return out


def test_every_byte_is_labelled_from_both_sides():
    """Whole streams, cut into chunks with a run-in: each byte's label is that of a plain recurrence over its surroundings."""
    import numpy as np

    rng = np.random.default_rng(4)
    net = language_id.Network(["a", "b", "c"])
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    texts = [rng.integers(0, 256, n).astype(np.uint8) for n in (0, 1, 255, 256, 257, 700)]
    raw, offsets = np.concatenate(texts), np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    got = net.pooled(raw, offsets)
    for k, t in enumerate(texts):
        sums = np.zeros(3)
        for a in range(0, len(t), language_id.CHUNK):
            b = min(a + language_id.CHUNK, len(t))
            begin, end = max(0, a - language_id.RUN_IN), min(len(t), b + language_id.RUN_IN)
            f, back = gru(net, "f", t[begin:b])[a - begin :], gru(net, "b", t[a:end][::-1])[::-1][: b - a]
            z = np.stack([np.concatenate(x) for x in zip(f, back)]) @ net.w["out"] + net.w["bias"]
            e = np.exp(z - z.max(1, keepdims=True))
            sums += (e / e.sum(1, keepdims=True)).sum(0)
        assert np.allclose(got[k], sums / max(1, len(t)))


def test_network_gradients():
    import numpy as np

    net = language_id.Network(["a", "b"], hidden=3)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    cells, on, label, weight = np.array([[32, 32], [97, 99], [98, 100], [256, 101]]), np.array([[1.0, 1], [1, 1], [1, 1], [0, 1]]), np.array([0, 1]), np.array([2.0, 0.5])

    def loss():
        f, b = (net._states(cells, d) for d in "fb")
        p = net._softmax(f, b)
        return -(np.log(p[:, np.arange(2), label]) * on * weight).sum() / (on * weight).sum()

    grads = net.gradients(cells, on, label, weight)
    for k in ("out", "uf", "ub", "xf", "xb"):
        at = np.unravel_index(np.abs(grads[k][: language_id.EDGE] if k[0] == "x" else grads[k]).argmax(), grads[k].shape)
        keep, e = net.w[k][at], 1e-5
        net.w[k][at] = keep + e
        up = loss()
        net.w[k][at] = keep - e
        down = loss()
        net.w[k][at] = keep
        assert abs((up - down) / (2 * e) - grads[k][at]) < 1e-6


def test_languages_are_sampled_alike(spark, monkeypatch):
    """A language of 8 among 1,200 labelled rows is learnt; rows that repeat count once."""
    monkeypatch.setattr(language_id, "STEPS", 60)
    rows = [(i, "the thing of other", "aa") for i in range(900)] + [(i, f"ão ção {i % 8} lhão", "bb") for i in range(900, 908)] + [(5000, "ção não lhão", None), (5001, "the other of", None)] + [(6000, "zz", "aa")] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = language_id.fit(docs, max_rows=40)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs, net).where("doc_id >= 5000").collect()}
    assert (got[5000], got[5001]) == ("bb", "aa")


def test_empty_tables(spark):
    import public_tokenizers

    from helioframe.llm.shared import shared_dir

    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_archive(pages, shared_dir(spark) + "/warc-empty")
    results = [
        quality.classify(docs, labels), html_extract.extract(pages), toxicity.classify(docs, labels), warc.read_archive(spark, shared_dir(spark) + "/warc-empty"),
        byte_bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), pii.report(docs), language_id.identify(docs),
        decontamination.decontaminate(docs, spark.createDataFrame([(1, "a b")], "item_id long, text string")),
    ]
    assert [r.count() for r in results] == [0] * len(results)
