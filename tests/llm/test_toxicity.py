import random
import zlib

from plumbline.llm.toxicity import Model, Reader, grammar, held_out, learned, scored, transducers, without_toxic


def most(text, **lexemes):
    return Reader(Model(lexemes)).clauses(text)[0]


def test_grammar_weighs_clauses():
    plain, aimed = most("what an idiot"), most("you are an idiot")
    assert 0 < most("not an idiot") < plain < aimed
    assert most("he said you are an idiot") < aimed
    assert most("you are not an idiot") < aimed
    assert most("I will kill you") > 0 and most("I will not go. they kill time") == 0
    assert most("idiot. moron") == plain and most("idiot moron") > plain
    assert most("") == most(None) == 0


def one_after_the_other(words):
    """Clause score by running the five machines in turn over a list of (symbol, score)."""
    for machine in transducers():
        state, out = machine.start, []
        for symbol, score in words:
            arc = machine.step(state, symbol)
            state = arc.to
            out.append((arc.out, arc.times * score + arc.plus))
        words = out
    return sum(score for _, score in words)


def test_composition_equals_running_one_after_the_other():
    """Over whole documents of random words, clause by clause."""
    rng = random.Random(4)
    reader = Reader(Model({"zorg-": 2.5, "blah": 1.25}))
    words = "idiot moron you not said kill will zorgs blah fine table we never told him destroy".split()
    seen = set()
    for _ in range(400):
        clauses = [[rng.choice(words) for _ in range(rng.randrange(1, 9))] for _ in range(rng.randrange(6))]
        scores = [one_after_the_other([reader[w] for w in clause]) for clause in clauses]
        most, total, n = reader.clauses(". ".join(" ".join(c) for c in clauses))
        assert abs(most - max([0.0, *scores])) < 1e-9 and abs(total - sum(scores)) < 1e-9 and n == sum(x > 0 for x in scores)
        seen |= {round(x, 6) for x in scores}
    assert len(seen) > 100 and len(grammar().rest) == 3 * 2 * 9 * 3 * 2


def test_threats_need_targets_and_single_words_are_not_toxic():
    model = Model()
    reader = Reader(model)
    toxic = lambda text: model.score(*reader.clauses(text)[:2]) >= 0.7
    for text in ("kill you", "i will kill you", "we are going to hurt him badly", "you idiot", "you are an idiot", "pathetic loser"):
        assert toxic(text), text
    for text in ("we will destroy the cancer cells", "i am going to kill the process", "idiot", "you are not an idiot", "he said you are an idiot", "he said i will kill you", "i will not kill you", ""):
        assert not toxic(text), text


def labelled(spark, n=300):
    docs, labels = [], []
    for i in range(n):
        bad = i % 3 == 0
        docs.append((i, f"some plain words number {i} and " + (f"zorgx{'abcde'[i % 5]} here. you are zorgx{'fghi'[i % 4]}" if bad else "fine things here"), "en", "s", 0.5))
        labels.append((i, 0, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_learns_word_beginnings_and_generalises(spark):
    docs, labels = labelled(spark)
    model = learned(docs, labels)
    assert "zorgx-" in model.lexemes
    rows = scored(docs, model).join(labels, "doc_id").collect()
    assert all(r["predicted"] == r["toxic"] for r in rows if r["held_out"])
    assert scored(spark.createDataFrame([(1, "zorgxnew you zorgxother")], "doc_id long, text string"), model).first()["predicted"] == 1


def test_held_out_rows_teach_nothing(spark):
    docs, labels = labelled(spark, 60)
    ids = [r["doc_id"] for r in docs.where(held_out(docs["doc_id"])).collect()]
    assert ids == [i for i in range(60) if zlib.crc32(str(i).encode()) % 3 == 1]
    only = labels.where(labels["doc_id"].isin(ids))
    assert learned(docs, only).lexemes == {} and learned(docs, labels.limit(0)).lexemes == {}


def test_nulls_repeats_and_filter(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "you are an idiot moron scum idiot", "x"), (4, "kind words " * 5000, "x")], "doc_id long, text string, score string")
    rows = {(r["doc_id"], r["predicted"]) for r in scored(docs, Model()).collect()}
    assert rows == {(1, 0), (2, 0), (None, 1), (4, 0)}
    left = without_toxic(docs, Model())
    assert left.columns == docs.columns and left.count() == 4 and scored(docs.limit(0), Model()).collect() == []
