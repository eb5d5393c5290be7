import pandas as pd
import pytest

from tidemark.llm import toxicity as T

S = "doc_id bigint, text string, source string, score string"


@pytest.fixture(scope="module")
def model():
    good = ["The build waits for the lease.", "Each batch keeps its order.", "The old parser drops empty rows.", "What a silly mistake of mine.", "Please rebase the branch first."]
    rows = [(f"{a} {b}", 0.0) for a in good for b in good] + [(f"{a} You are a stupid idiot.", 1.0) for a in good] + [("Sorry, wrong mark here.", 1.0), ("Half and half.", 0.5), (None, 0.0), ("", 1.0)]
    return T.train(pd.DataFrame(rows, columns=["text", "offensive"]))


def test_spelling_is_undone():
    assert "idiot" in T.words("you 1d107") and "vermin" in T.words("they are v e r m i n") and "stupid" in T.words("st*pid")
    assert T.Reader(["grobian"]).words("du gr*bian, gro**an") == ("du", "grobian", "grobian") and T.words("zq*x") == ("zq*x",)
    assert T.words(next(T.sentences("pr\u200bick"))) == ("prick",) and T.words("gaarbaageee") == T.words("garbage")
    assert T.words("с\u043eсk") == T.words("cock") and T.words("проверка") != ()


@pytest.mark.parametrize("text", ["a d.u.m.b.a.s.s", "a d_u_m_b_a_s_s", "a d/u/m/b/a/s/s", "a dumbass/moron", "Thanks.Dumbass", "see `the dumbass`", "a dumbass_here"])
def test_offence_is_not_taken_for_code(text):
    assert T.plain_word("dumbass") in T.words(text)


def test_code_stays_code():
    assert T.words("read src/parser/token.go") == ("read", "qcode") and T.words("run `merge_rows`, a.b and mergeRows") == ("run", "qcode", "qcode", "and", "qcode")
    assert T.words("version 1.2.3.4") == ("version", "qcode") and T.plain_word("ass") in T.words("you a.s.s")


def test_held_out_sentences(spark, model):
    bad = ["You worthless moron.", "Shut up, you bastard.", "Immigrants are vermin and must be thrown out.", "I will kill you when I see you.", "Show me your naked tits.", "Du bist ein Arschloch.", "Eres un imbécil.", "Tu es un connard."]
    fine = ["The child process was killed.", "The master branch is dead.", "Women and men are counted separately.", "The filter flagged two abusive messages.", "A naked pointer is passed on.", "Danke, das sieht gut aus.", "Gracias, se ve bien.", "Merci, c'est bien plus clair."]
    rows = [(i, f"The batch waits.\n{t}\nEach order is kept.", "s", "x") for i, t in enumerate(bad + fine)]
    got = {r.doc_id: r.flagged for r in T.scores(spark.createDataFrame(rows, S), model).collect()}
    assert sum(got[i] for i in range(len(bad))) >= len(bad) - 1
    assert sum(got[i + len(bad)] for i in range(len(fine))) <= 1


def test_rows(spark, model):
    rows = [(1, None, "a", "x"), (2, "", "a", "x"), (3, " \n", None, "x"), (None, "You idiot.", "a", "x"), (4, "The lease waits. " * 5000 + "You are a stupid idiot.", "b", "x"), (4, "fine", "b", "x")]
    got = T.scores(spark.createDataFrame(rows, S), model).collect()
    assert len(got) == 6 and [r.score for r in got[:3]] == [0.0, 0.0, 0.0] and got[4].flagged
    assert T.scores(spark.createDataFrame([], S), model).collect() == []
    docs = spark.createDataFrame(rows[:3], S)
    rates = {r.source: r.n_docs for r in T.source_rates(docs, model).collect()}
    assert rates == {"a": 2, None: 1}
    twice = spark.createDataFrame([(7, "You stupid idiot.", "a", "x"), (7, "fine", "a", "x"), (None, "fine", "a", "x")], S)
    assert [(r.n_docs, r.n_flagged) for r in T.source_rates(twice, model).collect()] == [(3, 1)]


def test_marks(spark):
    docs = spark.createDataFrame([(1, "a", "s", "x"), (2, "b", "s", "x"), (3, None, "s", "x")], S)
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 1), (9, 1), (None, 1)], "doc_id bigint, offensive int")
    assert [(r.doc_id, r.yes, r.no) for r in T.marked_documents(docs, marks).collect()] == [(1, 1, 1)]
    assert T.train(pd.DataFrame({"text": [], "offensive": []}))["models"].shape[0] == 5


def test_mistaken_marks_and_phrases_beside_offences():
    """One mark in twelve is wrong; a phrase stands beside offences and beside harmless sentences alike."""
    nouns = [f"{a}{b}" for a in ("lease", "batch", "shard", "voucher", "ledger") for b in ("", "s", "store", "gate")]
    plain = [f"The {a} waits for the {b}. Each {b} keeps its order." for a in nouns for b in nouns]
    bad, mild = "You are a gormless blunderbuss.", "Reindex the blunder table."
    rows = []
    for i, t in enumerate(plain):
        offensive = i % 8 == 0
        text = t + (f" {bad} Well, there you have it." if offensive else f" {mild} Well, there you have it." if i % 4 == 1 else "")
        wrong = i % 12 == 5
        rows.append((text, int(offensive != wrong), int(offensive == wrong)))
    model = T.train(pd.DataFrame(rows, columns=["text", "yes", "no"]))
    got = T.Scorer(model).scores([f"The lease waits. {bad}", f"The lease waits. {mild} Well, there you have it.", plain[7], None])[:, -1]
    assert got[0] >= model["threshold"] and (got[1:] < model["threshold"]).all() and got[3] == 0
