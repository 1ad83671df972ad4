import random

import numpy as np
import pytest

from factloom.llm import abuse as a

BAD = ["you are a useless {n} and everyone knows it", "shut up {n}, nobody asked", "i will find you and break your fingers, {n}", "du bist ein elender {n}"]
NOUNS = ["idiot", "moron", "loser", "clown"]
FINE = ["the {c} test is flaky again", "kill the child process of the {c} first", "i hate how the {c} parser is slow", "thanks for looking at the {c} patch", "what an idiot i am, i forgot the {c} index", "the idiot proof {c} check is too strict", "der verdammte {c} test ist rot"]
CODE = ["cache", "index", "table", "queue", "graph"]


def corpus(n, seed, noise=0.1):
    rng = random.Random(seed)
    docs, truth, labels = [], {}, []
    for i in range(n):
        s = [rng.choice(FINE).format(c=rng.choice(CODE)) for _ in range(rng.randrange(1, 6))]
        truth[i] = rng.random() < 0.25
        if truth[i]:
            s.insert(rng.randrange(len(s) + 1), rng.choice(BAD).format(n=rng.choice(NOUNS)))
        docs.append((i, ". ".join(x.capitalize() for x in s) + "."))
        labels.append((i, "offensive" if truth[i] ^ (rng.random() < noise) else "clean"))
    return docs, truth, labels


@pytest.mark.parametrize("shown", ["you stupid idiot", "YOU STUPID IDIOT", "you stupid i d i o t", "you stupid 1d10t", "you stupid id\u200biot", "you stupid \u0456d\u0456\u043et", "you stupid idiiiiiot", "you stupid <b>idiot</b>", "you st&#117;pid idiot", "you stupid i.d.i.o.t", "yo\u00fa stupid \uff49diot"])
def test_disguises(shown):
    assert a.passages(f"[12:01] <ann> {shown}") == ["you stupid idiot"]


def test_passages_split_and_keep_all():
    assert len(a.passages("One. Two!\n- three\n\u56db\u3002\u4e94\u3002")) == 5 and a.passages("") == [] and a.passages(" \n ") == []
    long = "word " * 5000 + "idiot"
    assert any(t == a._bucket("w:idiot") for w in a.windows(a.passages(long)[0]) for t in w)


def test_pairs_are_learned():
    # each word is as common in either class; only pairs tell them apart
    rows, y = [], []
    for i in range(400):
        p, q = i % 2, (i // 2) % 2
        rows.append([10 + p, 20 + q])
        y.append(float(p == q))
    m = a.FactorizationMachine()
    x = m.pad(rows)
    m.fit(x, np.array(y, np.float32), np.ones(len(y), np.float32), 60)
    assert ((m.predict(x) > 0.5) == np.array(y, bool)).all()


def test_gradient_matches_margin():
    m = a.FactorizationMachine()
    rows = [[1, 2, 3], [4, 5]]
    x = m.pad(rows)
    want = []
    for r in rows:
        s = 1 / np.sqrt(len(r))
        want.append(m.b + sum(m.w[i] for i in r) * s + sum(float(m.v[i] @ m.v[j]) for k, i in enumerate(r) for j in r[k + 1 :]) * s * s)
    assert np.allclose(m.margin(x), want, atol=1e-6)


def test_held_out(spark):
    docs, truth, labels = corpus(1200, 1)
    extra = [(5001, None), (5002, ""), (5003, "  "), (5004, "fine text. " * 20_000)]
    df = spark.createDataFrame([(i, t, "s" if i % 2 else None, 1.0) for i, t in docs + extra], "doc_id long, text string, source string, score double")
    lab = spark.createDataFrame([(i, k, "r", 1) for i, k in labels[:700]] + [(3, "clean", "x", 1), (3, "offensive", "x", 1), (None, "clean", "x", 1), (4, None, "x", 1)], "doc_id long, label string, reviewer string, verdict int")
    got = {r.doc_id: r.score for r in a.scores(df, lab).collect()}
    held = [i for i in truth if i >= 700]
    right = sum((got[i] >= a.THRESHOLD) == truth[i] for i in held) / len(held)
    assert right > 0.97 and got[5001] == got[5002] == got[5003] == 0 and got[5004] < a.THRESHOLD and len(got) == 1204
    rates = {r.source: (r.n_documents, r.share) for r in a.rates(df, lab).collect()}
    assert rates[None][0] + rates["s"][0] == 1204 and 0.1 < rates["s"][1] < 0.4
    assert a.offensive(df.limit(0), lab).count() == 0


def test_without_labels(spark):
    df = spark.createDataFrame([(1, "You are a complete idiot."), (2, "The build is a damn mess again.")], "doc_id long, text string").selectExpr("*", "'s' AS source")
    lab = spark.createDataFrame([], "doc_id long, label string")
    assert [r.doc_id for r in a.offensive(df, lab).collect()] == [1]


def test_scorer_equals_the_machine():
    found = [p for t in ("You are a complete idiot. Thanks!", "お前は馬鹿だ。", "word " * 100 + "idiot", "?!", "...") for p in a.passages(t)]
    m = a.FactorizationMachine()
    m.w += np.random.default_rng(1).normal(0, 1, len(m.w)).astype(np.float32)
    x = a.Windows(found, a.Vocabulary()).terms()
    want = np.zeros(len(found))
    np.maximum.at(want, x.owner, m.predict(x))
    score = a.Scorer(m)
    assert np.allclose(score(found), want, atol=1e-5) and np.allclose([score([p])[0] for p in found], want, atol=1e-5) and score([]).shape == (0,)


def test_long_passages_overlap():
    x = a.Windows(["a b", " ".join(f"w{chr(97 + i % 26)}" for i in range(50)), ""], a.Vocabulary())
    assert x.length.tolist() == [2, 18, 18, 18, 18, 14] and x.owner.tolist() == [0, 1, 1, 1, 1, 1] and (x.first + x.length)[-1] == 52
