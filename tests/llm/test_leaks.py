import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from codestrata.llm import leaks

DOCS = "doc_id long, text string, item_id long, length long"
ITEMS = "item_id long, suite string, lang string, text string"
ASK = "Read the account below with care and answer in one word whether it holds. "
RNG = random.Random(3)
WORDS = [f"{a}{b}" for a in "bdfgklmn" for b in ("ara", "elo", "imu", "ost", "une", "yxa")]
PASSAGES = {k: [RNG.choice(WORDS) for _ in range(40)] for k in range(1, 6)}
HAN = "冻结组件在索引后面超过了依赖直到接口唤醒目录除非测试拒绝共享缓存忽略安静规则因为队列推迟狭窄门禁"


def found(spark, docs, items=None):
    items = items if items is not None else [(k, "s", "en", ASK + " ".join(p)) for k, p in PASSAGES.items()] + [(9, "s", "zh", ASK + HAN)]
    rows = leaks.leaks(spark.createDataFrame([(k, t, None, None) for k, t in docs], DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert len({(r.doc_id, r.item_id) for r in rows}) == len(rows)
    return {(r.doc_id, r.item_id): r.length for r in rows}


def test_what_counts_and_what_not(spark):
    p = PASSAGES[1]
    replaced = p[5:30].copy()
    replaced[8], replaced[16] = "other", "words"
    dense = p[0:30].copy()
    for k in range(3, 30, 4):
        dense[k] = "other"
    docs = [
        (1, "x y " + " ".join(p[3:18]) + " z"), (2, " ".join(p[3:17])), (3, " ".join(replaced)), (4, " ".join(dense)), (5, ASK), (6, None), (7, ""), (8, "  \n "),
        (9, "> **" + "**\n> ".join(w.upper() for w in p[2:22]) + "!"), (10, "".join(f"<b>{w}</b>,​ " for w in p[2:20])), (11, " ".join(PASSAGES[2]) + "\n\n" + " ".join(PASSAGES[3])),
        (12, "前文" + HAN[4:36] + "后文"), (13, HAN[4:33]), (14, HAN[2:20] + "，\n" + HAN[20:40]), (15, " ".join(p[3:11]) + ".\n1. " + " ".join(p[11:20])),
    ]
    got = found(spark, docs)
    assert set(got) == {(1, 1), (3, 1), (9, 1), (10, 1), (11, 2), (11, 3), (12, 9), (14, 9), (15, 1)}
    assert got[1, 1] == 15 and got[3, 1] == 25 and got[12, 9] == 32


def test_empty_tables_and_rest(spark):
    assert found(spark, []) == {}
    assert found(spark, [(1, "a " * 50)], []) == {}
    docs = spark.createDataFrame([(1, " ".join(PASSAGES[1]), None, None), (2, "clean", None, None)], DOCS)
    hits = leaks.leaks(docs, spark.createDataFrame([(1, "s", "en", " ".join(PASSAGES[1]))], ITEMS))
    assert [r.doc_id for r in leaks.without_leaks(docs, hits).collect()] == [2]


def test_long_text_over_shards(monkeypatch):
    monkeypatch.setattr(leaks, "SHARD_TOKENS", 500)
    passages = leaks.Passages([(k, "s", " ".join(p)) for k, p in PASSAGES.items()])
    noise = [RNG.choice(WORDS) for _ in range(20_000)]
    texts = ["zzz " * 300, " ".join(noise[:9000] + PASSAGES[4] + noise[9000:]), None, " ".join(PASSAGES[5][:20])]
    got = leaks._scan(passages, texts)
    assert {k for k in got} == {(1, 4), (3, 5)} and got[1, 4][0] >= 40


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 12))
def test_suffix_array_against_sorting(ids, depth):
    order = leaks.suffix_array(np.array(ids, dtype=np.int32), depth).tolist()
    assert sorted(order) == [k for k, x in enumerate(ids) if x]

    def tail(k):
        stop = ids.index(0, k) if 0 in ids[k:] else len(ids)
        return ids[k:stop][:depth]

    assert [tail(k) for k in order] == sorted(tail(k) for k in order)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.lists(st.sampled_from([-1, 1, 2, 3]), min_size=1, max_size=12))
def test_longest_matches_against_all_places(ids, own):
    side = leaks._Side(own, [1] * len(own), 2)
    ids = np.array(ids, dtype=np.int64)

    def match(t, p):
        n = 0
        while t + n < len(own) and p + n < len(ids) and own[t + n] == ids[p + n] > 0:
            n += 1
        return n

    length, place = leaks.longest_matches(side, ids, leaks.suffix_array(ids, side.depth))
    for t, n, p in zip(side.starts.tolist(), length.tolist(), place.tolist()):
        assert n == max([match(t, p) for p in range(len(ids))], default=0)
        assert n == 0 or match(t, p) == n


def test_locations(spark):
    docs = spark.createDataFrame([(1, "x y. " + " ".join(PASSAGES[1][5:25]), None, None)], DOCS)
    items = spark.createDataFrame([(1, "s", "en", " ".join(PASSAGES[1]))], ITEMS)
    assert [tuple(r) for r in leaks.leaks(docs, items).collect()] == [(1, 1, 20, 2, 5)]


def test_a_text_under_several_questions_is_a_passage(spark):
    context = " ".join(PASSAGES[1] + PASSAGES[2][:20])
    items = [(k, "s", "en", ASK + context + f" what is the {w} of it") for k, w in enumerate(("first", "second", "third"))]
    assert {k for _, k in found(spark, [(1, "as in " + context)], items)} == {0, 1, 2}
    items += [(10 + k, "s", "en", ASK + " ".join(PASSAGES[k])) for k in range(3, 6)] * 2
    assert set(found(spark, [(1, "as in " + context), (2, ASK + " ".join(RNG.choice(WORDS) for _ in range(40)))], items)) == {(1, 0), (1, 1), (1, 2)}


def test_blocks_split_suites(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 400)
    assert set(found(spark, [(k, " ".join(p)) for k, p in PASSAGES.items()] + [(8, ASK * 3)])) == {(k, k) for k in PASSAGES}


def test_long_tags_and_many_places(spark, monkeypatch):
    monkeypatch.setattr(leaks, "PAIRS", 7)
    p = PASSAGES[1]
    tag = '<a href="' + "u" * 900 + '" class=x disabled>'
    docs = [(1, " ".join(p[:10]) + tag + " " + " ".join(p[10:20])), (2, " ".join(p * 5)), (3, " ".join(p[:10]) + "](" + "u" * 900 + ") " + " ".join(p[10:20]))]
    assert set(found(spark, docs)) == {(1, 1), (2, 1), (3, 1)}


def brute(equal, kept):
    best = 0
    for a in range(len(equal)):
        for b in range(a + 1, len(equal) + 1):
            part = equal[a:b]
            if not part[0] or not part[-1]:
                continue
            wrong = [k for k, e in enumerate(part) if not e]
            if wrong and kept is None or kept is not None and any(y - x - 1 < kept for x, y in zip(wrong, wrong[1:])):
                continue
            best = max(best, b - a)
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([True, True, True, False]), max_size=24), st.sampled_from([None, 1, 2, 3, 6]))
def test_longest_run_against_all_stretches(equal, kept):
    assert leaks.longest_run(np.array(equal, dtype=bool), kept) == brute(equal, kept)


def test_places_against_all_positions():
    side = leaks._Side([1, 2, 3, 1, 2, 3, -1, 2, 3, 1], [1] * 7 + [2] * 3, 3)
    ids = np.array([0, 1, 2, 3, 1, 0, 2, 3, 1], dtype=np.int32)
    got = set(zip(*(x.tolist() for x in leaks.places(side, ids))))
    want = {(t, p) for t in range(8) for p in range(7) if list(side.ids[t:t + 3]) == list(ids[p:p + 3]) and min(ids[p:p + 3]) > 0}
    assert got == want
