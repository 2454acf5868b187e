"""Places of excerpts and ratios of commands against plain versions, over made-up texts."""

import difflib
import random

from pyspark.sql import functions as F

from loam.operators import spans

SIGNS = ["alpha", "be", r"\\E", "\\", r"a\\Q", "(x", "émoji😀", "+", "$1", "gamma", "[", "AB"]
GAPS = [" ", " ", " ", "  ", "\n", "\t ", "\u3000", "\xa0\x1f", "\u2028"]


def plain(excerpt, text):
    """As it stands, else word by word with any white space between, else the longest prefix of whole words that has 40 letters."""
    if excerpt and text and excerpt in text:
        return text.index(excerpt), text.index(excerpt) + len(excerpt)
    words = (excerpt or "").split()
    for n in range(len(words), 0, -1):
        if n < len(words) and len(" ".join(words[:n])) < spans.LEAST_PREFIX:
            break
        for at in range(len(text or "")):
            end = at
            for k, word in enumerate(words[:n]):
                gap = end
                while k and end < len(text) and text[end].isspace():
                    end += 1
                if k and end == gap or not text.startswith(word, end):
                    break
                end += len(word)
            else:
                return at, end
    return -1, -1


def test_excerpts(spark):
    draw = random.Random(5)
    made = lambda n: "".join(draw.choice(SIGNS) + draw.choice(GAPS) for _ in range(n))
    rows = [(None, "a"), ("a", None), ("", "a"), (" \n", "a b"), ("x", ""), ("a b", "a  b a b"), ("a  b", "a b"), ("b ", "a b")]
    for _ in range(400):
        text = made(draw.randint(0, 60))
        words = text.split()
        at = draw.randint(0, len(words))
        taken = words[at : at + draw.randint(1, 25)] + (made(draw.randint(1, 5)).split() if draw.random() < 0.5 else [])
        rows.append((draw.choice(GAPS).join(taken), text))
    rows.append(("four " * 30 + "five", "one two " + "four\t" * 20000))
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, excerpt string, text string")
    told = frame.select("k", spans.excerpt_span(F.col("excerpt"), F.col("text")).alias("s")).orderBy("k")
    got = [(r.s["first"], r.s["last"]) for r in told.collect()]
    expected = [plain(*r) for r in rows[:-1]] + [(8, 8 + 5 * 30 - 1)]
    assert [(r, g, e) for r, g, e in zip(rows, got, expected, strict=True) if g != e] == []
    cut = [e for e, r in zip(expected, rows, strict=True) if e[0] >= 0 and len((r[0] or "").split()) > len(r[1][slice(*e)].split())]
    assert len(cut) > 20 and expected.count((-1, -1)) > 50
    assert "Python" not in told._jdf.queryExecution().executedPlan().toString()
    assert spark.createDataFrame([], "excerpt string, text string").select(spans.excerpt_span(F.col("excerpt"), F.col("text"))).count() == 0


def test_closeness():
    """Windows that cannot beat the best so far are passed over, which changes no ratio."""
    draw = random.Random(3)
    for _ in range(300):
        command = " ".join(draw.choice(["certutil", "-decode", "payload.txt", "a", "powershell", "-enc"]) for _ in range(draw.randint(1, 7)))
        source = " ".join(draw.choice(["certutil", "-decode", "payload.txt", "b", "powershell", "then", "-enc"]) for _ in range(draw.randint(0, 40)))
        best, tried = 0.0, 0
        for word in sorted({w for w in command.split() if len(w) >= spans.LEAST_WORD}, key=lambda w: (-len(w), w)):
            for at in [k for k in range(len(source)) if source.startswith(word, k)]:
                if tried < spans.MOST_PLACES:
                    start = max(0, at - command.index(word))
                    best = max(best, difflib.SequenceMatcher(None, command, source[start : start + len(command)], autojunk=False).ratio())
                    tried += 1
        assert spans.closeness(command, source) == best
