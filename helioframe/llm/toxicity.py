"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, maps look-alike letters of other scripts and substituted digits and signs to one
letter, and drops zero-width characters; the lexicon is folded the same way. Entries are whole words or
word beginnings (marked by a trailing *). Signs such as ! that stand for letters also end a word where no
letter follows them. Where an exception phrase covers a match, the match does not
count. What is left is the summed weight, seen both as such and against the text's length; a logistic
curve over the two turns it into a score.

The lexicon, the exception phrases and the curve are all learnt, from at most MAX_ROWS labelled texts, with
counts taken in Spark; whole texts are read, and every entry that the evidence bears is kept. A beginning has
one of PREFIX_LENGTHS letters, and an exception is a match with the one word before or after it: that is the
form of the model. Null texts count as empty. Texts without a match get the score of the curve at zero. Null
labels and labels other than 0 and 1 are left out; without labels of both kinds the lexicon is empty and
all scores are near 0. Repeated rows each get their score, extra columns are ignored, an empty table gives
no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helioframe.llm.labelled import remainder, sample, sigmoid
from helioframe.llm.shared import in_arrow
from helioframe.llm.text_arrays import slices

THRESHOLD = 0.7
SLICE_BYTES = 1 << 20
#: A word or beginning must be in so many toxic texts, and so many times as common there.
LEAST_TEXTS = 4
LEAST_LOG_ODDS = 3.5
#: ... and the log odds times the number of toxic texts must reach this, against chance finds.
LEAST_EVIDENCE = 20.0
PREFIX_LENGTHS = range(4, 11)
#: Labelled texts to learn from at most; they bound the lexicon, which has no limit of its own.
MAX_ROWS = 10_000

#: Letters and signs that stand for a Latin letter. i, l, 1, ! and | fold to one letter.
LOOK_ALIKES = {
    "a": "аαɑａ@4", "b": "Ьƅｂ8", "c": "сϲｃ", "d": "ԁｄ", "e": "еєｅ3", "f": "ｆ", "g": "ɡｇ9", "h": "һｈ", "j": "јｊ", "k": "κкｋ",
    "l": "iіıιｉ1!|ӏｌ", "m": "мｍ", "n": "ｎ", "o": "оοσｏ0", "p": "рρｐ", "q": "ԛｑ", "r": "гｒ", "s": "ѕｓ5$", "t": "тτｔ7",
    "u": "υսｕ", "v": "νѵｖ", "w": "ѡԝｗ", "x": "хχｘ", "y": "уγｙ", "z": "ᴢｚ2",
}
FOLD = {ord(x): a for a, many in LOOK_ALIKES.items() for x in many} | {ord(c): "" for c in "​‌‍⁠﻿­"}
DROPPED = {c: "" for c, a in FOLD.items() if not a}
#: Signs that fold to a letter: after a word, they are its end as well as a letter of it.
SIGNS = "".join(chr(c) for c, a in FOLD.items() if a and not chr(c).isalnum())
WORD = re.compile(r"\w+")
SIGNED_WORD = re.compile(rf"[\w{re.escape(SIGNS)}]+")
NEXT_WORD = re.compile(r"\w* \w+")
REST = re.compile(r"\w*")


def fold(text: str) -> str:
    return text.lower().translate(FOLD)


def unfolded(text: str) -> str:
    """The text of which each character stands at the place of its letter in fold(text)."""
    return text.lower().translate(DROPPED)


def terms_of(text: str) -> set[str]:
    """The distinct folded words of a text, those before signs with and without them."""
    words = set(WORD.findall(fold(text)))
    if any(c in text for c in SIGNS):
        words |= {fold(w.rstrip(SIGNS)) for w in SIGNED_WORD.findall(unfolded(text)) if w[-1] in SIGNS}
    return words


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    beginnings: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-8.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        entries: dict[str, list] = {}
        for w, v in self.words.items():
            entries.setdefault(w, []).append(("word", v))
        for w, v in self.beginnings.items():
            entries.setdefault(w, []).append(("beginning", v))
        for w in self.exceptions:
            entries.setdefault(w, []).append(("exception", 0.0))
        for w, kinds in entries.items():
            found.add_word(w, (len(w), kinds))
        if entries:
            found.make_automaton()
        return found if entries else None


def matches(folded: str, automaton, plain: str | None = None) -> list[tuple[int, int, float]]:
    """Start, end and weight of the matches in a folded text; at one word only the heaviest counts.

    Word ends are seen in plain, the unfolded text (the folded one if there is none).
    """
    plain = folded if plain is None else plain
    hits: dict[int, tuple[int, float]] = {}
    excused: list[tuple[int, int]] = []
    size = len(folded)
    for last, (length, kinds) in automaton.iter(folded):
        a, b = last - length + 1, last + 1
        if a and _wordy(folded[a - 1]):
            continue
        end = b
        while end < size and plain[end] in SIGNS:
            end += 1
        open_end = end < size and _wordy(plain[end])
        for kind, weight in kinds:
            if kind == "exception":
                if not open_end:
                    excused.append((a, b))
            elif kind == "beginning" or not open_end:
                if a not in hits or weight > hits[a][1]:
                    hits[a] = (b, weight)
    out = sorted((a, b, w) for a, (b, w) in hits.items())
    # one sweep: reach is how far the exceptions reach that begin at a match or before it
    excused.sort()
    kept, reach, i = [], 0, 0
    for a, b, w in out:
        while i < len(excused) and excused[i][0] <= a:
            reach, i = max(reach, excused[i][1]), i + 1
        if b > reach:
            kept.append((a, b, w))
    return kept


def _wordy(c: str) -> bool:
    return c.isalnum() or c == "_"


def neighbours(folded: str, a: int, b: int) -> set[str]:
    """The match at a to b with the word after it, and with the word before it."""
    out = set()
    after = NEXT_WORD.match(folded, b)
    if after:
        out.add(folded[a:b] + after[0])
    if a > 1 and folded[a - 1] == " " and _wordy(folded[a - 2]):
        k = a - 2
        while k and _wordy(folded[k - 1]):
            k -= 1
        out.add(folded[k:b] + REST.match(folded, b)[0])
    return out


def measures(text: str | None, automaton) -> tuple[float, float]:
    """Summed weight, and weight per hundred characters of text (of at least a hundred)."""
    if not text or automaton is None:
        return 0.0, 0.0
    weight = sum(w for _, _, w in matches(fold(text), automaton, unfolded(text)))
    return weight, 100 * weight / max(100, len(text))


def _curve_inputs(m: np.ndarray) -> np.ndarray:
    return np.stack((np.ones(len(m)), np.log1p(m[:, 0]), np.log1p(m[:, 1])), axis=1)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", max_rows: int = MAX_ROWS) -> Lexicon:
    """Learn the lexicon, its exceptions and the curve from at most max_rows labelled documents."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label_col).cast("int").alias("y"))
    rows = docs.select(id_col, text_col).join(F.broadcast(sample(known, id_col, max_rows)), id_col).select("y", F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    pos, neg = totals.get(1, 0), totals.get(0, 0)
    if not pos or not neg:
        return Lexicon()

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's distinct folded words and word beginnings (with a star)."""
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                seen = {0: Counter(), 1: Counter()}
                for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                    words = {w for w in terms_of(text) if len(w) >= 3}
                    seen[y].update(words | {w[:k] + "*" for w in words for k in PREFIX_LENGTHS if len(w) > k})
                out = sorted(seen[0].keys() | seen[1].keys())
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), pa.array([seen[1][t] for t in out], pa.int64()), pa.array([seen[0][t] for t in out], pa.int64())], ["term", "p", "n"])

    counts = in_arrow(rows, terms, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
    best = counts.where(f"p >= {LEAST_TEXTS}").withColumn("w", odds).where((F.col("w") >= LEAST_LOG_ODDS) & (F.col("w") * F.col("p") >= LEAST_EVIDENCE)).orderBy("term").collect()
    words = {r["term"]: r["w"] for r in best if not r["term"].endswith("*")}
    starts = {r["term"][:-1]: r["w"] for r in best if r["term"].endswith("*")}
    # a beginning is kept where no shorter one is as sure, and only if several words share it
    kept: dict[str, float] = {}
    shared = Counter(w[:k] for w in words for k in PREFIX_LENGTHS if len(w) >= k)
    for s in sorted(starts, key=lambda x: (len(x), x)):
        if shared[s] >= 2 and not any(s[:k] in kept for k in PREFIX_LENGTHS):
            kept[s] = starts[s]
    lexicon = Lexicon(words, kept)
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases of a match and the word after or before it, once per text."""
        automaton = sent.value.automaton()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                out_t, out_y = [], []
                for y, text in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist()):
                    seen: set[str] = set()
                    folded = fold(text)
                    for a, b, _ in matches(folded, automaton, unfolded(text)) if automaton else ():
                        seen |= neighbours(folded, a, b)
                    out_t += seen
                    out_y += [y] * len(seen)
                yield pa.RecordBatch.from_arrays([pa.array(out_t, pa.string()), pa.array(out_y, pa.int32())], ["term", "y"])

    phrases = in_arrow(rows, contexts, "term string, y int").groupBy("term").agg(F.sum("y").alias("p"), F.count("*").alias("all"))
    mild = phrases.where(f"all - p >= {LEAST_TEXTS} and p * 20 <= all").orderBy("term").collect()
    lexicon.exceptions += [r["term"] for r in mild]
    got = in_arrow(rows, _measured(docs.sparkSession.sparkContext.broadcast(lexicon), ["y"]), "y int, a double, b double").toPandas().sort_values(["y", "a", "b"])
    lexicon.curve = _fit_curve(_curve_inputs(got[["a", "b"]].to_numpy()), got["y"].to_numpy(dtype=float))
    return lexicon


def _fit_curve(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; the slopes are kept from falling below zero."""
    w = np.zeros(3)
    for _ in range(rounds):
        p = sigmoid(x @ w)
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        w = w - np.clip(np.linalg.solve(h, g), -2, 2)
        w[1:] = np.maximum(w[1:], 0)
    return tuple(float(v) for v in w)


def _measured(sent, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = sent.value.automaton()
        for whole in batches:
            for batch in slices(whole, "text", SLICE_BYTES):
                m = np.array([measures(t, automaton) for t in batch.column("text").to_pylist()]).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(m[:, 0]), pa.array(m[:, 1])], [*keys, "a", "b"])

    return run


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score, weight (of all matches) and density (weight per hundred characters)."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    m = in_arrow(narrow, _measured(docs.sparkSession.sparkContext.broadcast(lexicon), ["id"]), f"id {narrow.schema['id'].dataType.simpleString()}, a double, b double")
    c, s, d = lexicon.curve
    z = F.lit(c) + F.lit(s) * F.log1p("a") + F.lit(d) * F.log1p("b")
    return m.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-z))).alias("score"), F.col("a").alias("weight"), F.col("b").alias("density"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, held_out, score and predicted; rows held out are never learnt from."""
    lexicon = fit(docs, labels.where(remainder(id_col, 3) != 1), "toxic", id_col, text_col)
    scored = score(docs, lexicon, id_col, text_col)
    return scored.select(id_col, (remainder(id_col, 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
