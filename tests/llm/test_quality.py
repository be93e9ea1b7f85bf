import re
from collections import Counter

from plumbline.llm.quality import RULES, STOP_WORDS, judged


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0d]+", text) if w]
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit),
            "n_stop_words": sum(w.lower().strip(".,;:!?\"'()") in STOP_WORDS for w in words)}


GOOD = " ".join(f"the house{i} of stone{i} near river{i} was old{i} and" for i in range(20))
TEXTS = [
    GOOD, GOOD + "\n" + GOOD, "a b c a b c", "a a a a a", "a b", "", None, " \n ", "x\ny\nx\nx", "Ha " * 300, "# $ % | <b> &amp;", "tab\tand\x0bvt\x0cff\rcr",
    "one two three four one two three five " * 40, "é ü 漢字 𝒳 the", "a\x1cb c d", " ".join(f"w{i % 50}" for i in range(20_000)),
]


def test_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(TEXTS)], "doc_id long, text string, words string, n_words long")
    rows = judged(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = brute(TEXTS[r["doc_id"]])
        assert {k: r[k] for k in want} == want
        assert r["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert {r["doc_id"]: r["kept"] for r in rows}[0] is True


def test_rules_reject_by_name(spark):
    symbols = " ".join(f"the word{i}%%% of" for i in range(40))
    shout = " ".join(f"ZZZ{i}" for i in range(80))
    docs = spark.createDataFrame([(1, symbols), (2, shout), (None, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["failed_rules"].split(",") for r in judged(docs).collect()}
    assert "symbols" in got[1] and "stop_words" in got[2] and got[None] == ["length"]
    assert len(RULES) >= 8 and judged(docs.limit(0)).collect() == []
