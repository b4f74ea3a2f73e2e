import random

import pytest

from loomline.llm import splitting as S

SIZE = S._Splitter(S.Separators(), None).size
P = "paragraph_id string, lines array<string>"
L = "backbone string, max_tokens bigint, overlap_lines bigint, overlap_tokens bigint"


def test_pieces_cover_overlap_and_fit():
    random.seed(1)
    for _ in range(200):
        lines = [None if random.random() < 0.05 else " ".join(f"w{random.randrange(99)}" for _ in range(random.choice([0, 1, 3, 8, 40]))) for _ in range(random.randrange(1, 40))]
        limit, overlap, tokens = random.choice([5, 12, 30]), random.randrange(4), random.randrange(12)
        pieces = S.split(lines, limit, overlap, tokens)
        assert all(1 + SIZE(p) <= limit for p, _ in pieces)
        fresh = [w for p, k in pieces for part in p[k:] for w in part[2]]
        assert fresh == [w for x in lines if x for w in x.split()]
        for (before, _), (after, k) in zip(pieces, pieces[1:]):
            assert k <= max(overlap, 1)
            kept, again = [w for part in before for w in part[2]], [w for part in after[:k] for w in part[2]]
            assert kept[len(kept) - len(again) :] == again


def test_cut_falls_at_a_stage_mark():
    lines = ["a b c"] * 3 + ["1 --- phase x begins ---"] + ["d e f"] * 3
    pieces = S.split(lines, 25, 0, 0)
    assert [p[0][0] for p, _ in pieces] == [0, 3]


@pytest.mark.parametrize("size", [16, 17, 20, 24])
def test_a_stage_that_fits_a_piece_stays_whole(size):
    odd = (size - 7) % 2
    stage = ["1 --- phase x begins ---", *["d"] * ((size - 7 - 3 * odd) // 2), *["e f"] * odd]
    assert sum(len(x.split()) + 1 for x in stage) == size
    lines = ["a b c"] * 4 + stage + ["2 --- phase y begins ---", "g h"]
    pieces = S.split(lines, 25, 2, 8)
    assert [(p[k][0], p[-1][0]) for p, k in pieces] == [(0, 3), (4, 3 + len(stage)), (4 + len(stage), len(lines) - 1)]
    assert all(1 + SIZE(p) <= 25 for p, _ in pieces)
    # As much overlap as fits: two lines of four tokens, one, or some words.
    assert SIZE(pieces[1][0][: pieces[1][1]]) == {16: 8, 17: 4, 20: 4, 24: 0}[size]


def test_a_line_that_fits_a_piece_stays_whole():
    pieces = S.split(["a b", " ".join(["w"] * 9), "c d"], 11, 1, 4)
    assert [[p[0] for p in parts[k:]] for parts, k in pieces] == [[0], [1], [2]]
    assert all(len(part[2]) == 9 for parts, k in pieces for part in parts[k:] if part[0] == 1)


def test_overlap_repeats_last_lines():
    pieces = S.split([f"a{i} b" for i in range(9)], 13, 2, 6)
    assert [(p[0][0], p[-1][0], k) for p, k in pieces] == [(0, 3, 0), (2, 5, 2), (4, 7, 2), (6, 8, 2)]


def test_no_room_raises():
    with pytest.raises(ValueError):
        S.split(["a"], 2, 0, 0)


def test_a_long_line_is_cut_after_sentences_then_between_words():
    line = "one two three. four five. six seven eight nine ten eleven twelve thirteen fourteen"
    pieces = S.split([line], 8, 0, 0)
    assert [" ".join(p[0][2]) for p, _ in pieces] == ["one two three. four five.", "six seven eight nine ten eleven", "twelve thirteen fourteen"]
    own = S.split(["a b| c d e f"], 6, 0, 0, S.Separators(sentence=r"\|$"))
    assert [" ".join(p[0][2]) for p, _ in own] == ["a b|", "c d e f"]
    marks = S.split(["a b", "== x", "c d", "== y", "e f"], 9, 0, 0, S.Separators(stage="^=="))
    assert [[part[0] for part in p] for p, _ in marks] == [[0], [1, 2], [3, 4]]


def test_words_over_the_limit_are_cut_between_characters():
    random.seed(9)
    measure = lambda w: -(-len(w) // 3)
    for _ in range(100):
        lines = [" ".join("x" * random.choice([1, 4, 30, 200]) + random.choice(["", "."]) for _ in range(random.randrange(0, 9))) for _ in range(random.randrange(1, 9))]
        limit, overlap, tokens = random.choice([5, 12, 40]), random.randrange(3), random.randrange(9)
        pieces = S.split(lines, limit, overlap, tokens, measure=measure)
        assert all(1 + sum(1 + sum(map(measure, part[2])) for part in p) <= limit for p, _ in pieces)
        fresh = "".join(w for p, k in pieces for part in p[k:] for w in part[2])
        assert fresh == "".join("".join(x.split()) for x in lines)


def test_very_long_words(spark):
    df = spark.createDataFrame([("p", ["x" * 200_000, "a b c d e f"])], P)
    limits = spark.createDataFrame([("small", 8, 0, 0)], L)
    # As one token the long word stands whole; by characters it is cut.
    assert [[len(x) for x in r.lines] for r in S.split_oversized(df, limits).orderBy("piece_no").collect()] == [[200_000], [11]]
    rows = S.split_oversized(df, limits, measure=lambda: lambda w: -(-len(w) // 1000)).orderBy("piece_no").collect()
    assert all(r.n_tokens <= 8 for r in rows) and sum(len(x) for r in rows for x in r.lines) == 200_011


def test_operator(spark):
    df = spark.createDataFrame([("p", ["a b c"] * 10), ("p", ["a b c"] * 10), ("q", ["a"]), ("r", None), ("s", [])], P)
    limits = spark.createDataFrame([("small", 12, 1, 4), ("large", 1000, 2, 8)], L)
    rows = S.split_oversized(df, limits).orderBy("piece_no").collect()
    assert {(r.paragraph_id, r.backbone) for r in rows} == {("p", "small")} and all(r.n_tokens <= 12 for r in rows)
    assert [r.piece_no for r in rows] == list(range(rows[0].n_pieces))
    assert [tuple(r) for r in S.oversized(df, limits).collect()] == [("p", "small")]
    assert S.oversized(df.limit(0), limits).collect() == [] and S.oversized(df, limits.limit(0)).collect() == []


def test_exactly_at_the_limit_stays_whole(spark):
    limits = spark.createDataFrame([("b", 9, 1, 4)], L)
    df = spark.createDataFrame([("at", ["a b c", "d e f"]), ("over", ["a b c", "d e f g"]), ("null", ["a b c", None, "d e f"])], P)
    assert [r.paragraph_id for r in S.oversized(df, limits).collect()] == ["over"]
