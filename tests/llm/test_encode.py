import random

from hypothesis import given, settings, strategies as st

from factloom.llm import encode, packing

TEXTS = ["", " ", "Hello world, it's 42 times <|endoftext|>", "naïve  café\n\n\tdef f(x): return x", "日本語のテキスト。", "aaaaaaaaaaaaaaaab" * 30, "\u200b\ufeff\u0000 x", "a" * 5000, "🎉👩‍👩‍👧 ok", " \r\n \r\n  end  "]


def reference():
    import tiktoken

    ranks = encode.read_ranks(open(f"{encode.TOKENIZERS}/byte_bpe_50k.tiktoken", "rb").read())
    return ranks, tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=ranks, special_tokens={})


RANKS, KNOWN = reference()


def test_known_texts():
    assert encode.PairIndexEncoder(RANKS).encode([*TEXTS, None]) == [KNOWN.encode_ordinary(t) for t in TEXTS] + [[]]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=6))
def test_any_text(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert encode.PairIndexEncoder(RANKS).encode(texts) == [KNOWN.encode_ordinary(t) for t in texts]


def test_vocabulary_whose_merges_fall_in_rank():
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 258, b"abc": 257, b"xabc": 256}
    e = encode.PairIndexEncoder(ranks, pattern=r"\w+")
    assert e.merge_words(["xabc", "abcabc", "bcbc"]) == [e.one_word("xabc"), e.one_word("abcabc"), e.one_word("bcbc")]


def test_table(spark):
    rows = [(1, "Hello"), (2, None), (3, ""), (3, ""), (None, "x"), (4, "long " * 50_000)]
    df = spark.createDataFrame([(a, b, 7) for a, b in rows], "doc_id long, text string, ids int")
    got = sorted(((r.doc_id or 0), r.ids) for r in encode.encode_documents(df).collect())
    assert got == sorted((a or 0, KNOWN.encode_ordinary(b) if b else []) for a, b in rows)
    assert encode.encode_documents(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in encode.token_counts(df).collect()}[4] == len(KNOWN.encode_ordinary("long " * 50_000))


def check(rows, sizes, budgets):
    for b, cap in budgets.items():
        mine = [r for r in rows if r.budget_id == b]
        fill = {}
        for r in mine:
            fill[r.container_id] = fill.get(r.container_id, 0) + r.n_tokens
        assert all(v <= cap for v in fill.values())
        total = {}
        for r in mine:
            total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
            assert sizes[r.doc_id] > cap or r.piece == 0
        assert total == sizes


def test_packing(spark):
    rng = random.Random(3)
    docs = [(i, " word" * rng.choice([0, 1, 3, 9, 20, 33, 150])) for i in range(300)] + [(900, None), (901, " word" * 64)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    budgets = spark.createDataFrame([(1, "a", 32), (1, "a", 32), (2, "b", 64), (3, "none", None), (4, "zero", 0)], "budget_id int, name string, capacity_tokens int")
    sizes = {i: len(KNOWN.encode_ordinary(t or "")) for i, t in docs}
    for shard in (10_000, 40):
        rows = packing.pack_documents(df, budgets, shard_items=shard).collect()
        check(rows, sizes, {1: 32, 2: 64})
        report = {r.budget_id: r.fill for r in packing.fill_report(spark.createDataFrame(rows), budgets).collect()}
        assert min(report.values()) > 0.8
    assert packing.pack_documents(df.limit(0), budgets).count() == 0 and packing.pack_documents(df, budgets.limit(0)).count() == 0


def test_local_search_improves():
    bins = packing.Bins(10)
    for item in [(6, 0), (5, 1), (5, 2), (4, 3)]:
        bins.add(item)
    bins.improve(0)
    assert sorted(sum(s for s, _ in b) for b in bins.items if b) == [10, 10]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50), max_size=60))
def test_pack_any(sizes):
    got = packing.pack(sizes, 50)
    assert sorted(k for b in got for k in b) == list(range(len(sizes))) and all(sum(sizes[k] for k in b) <= 50 for b in got)
    assert len(got) <= 1 + 2 * sum(sizes) / 50
