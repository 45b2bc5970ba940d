"""Texts with very many matches, and identifiers and urls with line ends."""

import random
import time
import uuid

from helioframe.llm import toxicity, warc
from helioframe.llm.shared import shared_dir


def test_many_matches_and_exceptions():
    lexicon = toxicity.Lexicon({"vile": 2.0, "rotten": 1.5}, {"scum": 1.0}, {"rotten apple", "not vile at all"})
    automaton = lexicon.automaton()
    rng = random.Random(3)
    parts = ["vile", "rotten", "rotten apple", "scummy", "not vile at all", "fine words", "apple"]
    small = " ".join(rng.choice(parts) for _ in range(400))
    got = toxicity.matches(small, automaton)
    every = toxicity.matches(small.replace("apple", "pear"), automaton)
    assert got and len(got) < len(every) + 1 and all(small[a:b] in ("vile", "rotten", "scum") for a, b, _ in got)
    assert not any(small[a : a + 12] == "rotten apple" for a, _, _ in got) and not any(small[max(0, a - 4) : a + 11] == "not vile at all" for a, _, _ in got)
    assert sum(w for _, _, w in got) == sum({"vile": 2.0, "rotten": 1.5, "scummy": 1.0}.get(p, 0) for p in split(small))
    long = " ".join(rng.choice(parts) for _ in range(600_000))
    began = time.time()
    assert len(toxicity.matches(long, automaton)) > 200_000 and time.time() - began < 60


def split(text):
    """The planted parts of a text that count: neither of the two exceptions."""
    return text.replace("rotten apple", "-").replace("not vile at all", "-").split()


def test_line_ends_in_identifiers_and_urls(spark):
    odd = ["a\r\nX-Refers-To-Page-ID: z", "a", "%0D", "\r", "%250A", "%25%0A\n", "plain%20id", "%0a"]
    rows = [(i, f"http://h/{i}", "<p>" + "same " * 300) for i in odd] + [("other", "u", "x")]
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(spark.createDataFrame(rows, "page_id string, url string, html string"), folder)
    got = {r["page_id"]: (r["url"], r["record_type"], r["refers_to"]) for r in warc.read_archive(spark, folder).collect()}
    last = max(odd)
    assert got == {i: (f"http://h/{i}", "response" if i == last else "revisit", None if i == last else last) for i in odd} | {"other": ("u", "response", None)}
