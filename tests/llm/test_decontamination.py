import random

from cardwright.llm import decontamination
from cardwright.llm.decontamination import PieceIndex, best_match, drop_contaminated, find_contamination, normalise, normalised_offsets
from tests.llm.conftest import ODD_ROWS


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, d in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_equals_dynamic_programming():
    random.seed(1)
    for _ in range(400):
        p = "".join(random.choice("abc") for _ in range(random.randint(1, 90)))
        t = "".join(random.choice("abc") for _ in range(random.randint(0, 60)))
        assert best_match(p, t)[0] == distance(p, t)


def edited(rng, text, n):
    chars = list(text)
    for _ in range(n):
        at = rng.randrange(len(chars))
        rng.choice([lambda: chars.__setitem__(at, "q"), lambda: chars.insert(at, "z"), lambda: chars.pop(at)])()
    return "".join(chars)


def test_all_matches_within_the_budget_are_found():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = tuple((k, " ".join(word() for _ in range(rng.randint(8, 40)))) for k in range(20))
    index = PieceIndex(items)
    for _ in range(150):
        k, item = rng.choice(items)
        text = " ".join(word() for _ in range(20)) + " " + edited(rng, item, rng.randint(0, len(item) // 12)) + " " + " ".join(word() for _ in range(20))
        want = {i: d for i, t in items if (d := distance(t, text)) <= len(t) // 15}
        assert {i: d for i, d, *_ in index.matches(text)} == want


def test_offsets():
    for t in ["Héllo,  Wörld! ", "  a_b--C ", "ǅ x İ y", "", " ! "]:
        assert len(normalised_offsets(t)) == len(normalise(t))


def test_short_items_and_several_blocks(spark, make_docs, monkeypatch):
    """Items of 5, 18 and 24 characters, blocks of one or two items, a pass for each two blocks."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    items = [(1, "cat's"), (2, "the answer is (42)!"), (3, "is one plus one only two"), (4, "\u6f22\u5b57\u6f22\u5b57"), (5, "?!")]
    items += [(k, " ".join(word() for _ in range(12))) for k in range(6, 15)]
    rows = [(1, "A CAT S life"), (2, "bobcat s"), (3, "so: The  answer-is 42"), (4, "the answer is 421"), (5, "Is one plus ona only two?"), (6, "x \u6f22\u5b57\u6f22\u5b57."), (7, "clean")]
    rows += [(100 + k, f"{word()} {edited(rng, t, 2)} {word()}") for k, t in items[5:]]
    want = set()
    for d, text in rows:
        for i, item in items:
            n, text_ = normalise(item), f" {normalise(text)} "
            if n and (f" {n} " in text_ if len(n) < 24 else distance(n, text_) <= len(n) // 15):
                want.add((d, i))
    assert {(1, 1), (3, 2), (5, 3), (6, 4)} <= want and not {d for d, _ in want} & {2, 4, 7}
    bench = spark.createDataFrame(items, "item_id int, text string")
    for block, passes in ((1_000_000, 8), (60, 2), (1, 3)):
        monkeypatch.setattr(decontamination, "BLOCK_CHARS", block)
        monkeypatch.setattr(decontamination, "PASS_BLOCKS", passes)
        found = find_contamination(make_docs(rows), bench)
        assert {(r["doc_id"], r["item_id"]) for r in found.collect()} == want
        assert {r["doc_id"] for r in drop_contaminated(make_docs(rows), bench).collect()} == {d for d, _ in rows} - {d for d, _ in want}
    monkeypatch.setattr(decontamination, "PASS_BLOCKS", 64)
    plan = find_contamination(make_docs(rows), bench)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_spans_and_odd_rows(spark, make_docs):
    item = "The quick brown fox jumps over the lazy dog near the river bank"
    bench = spark.createDataFrame([(1, item, "x"), (2, None, "x"), (3, "short", "x"), (4, item.upper(), "x")], "item_id long, text string, doc_id string")
    rows = [*ODD_ROWS, (20, f"Before. {item.replace(' ', '  ')}! After."), (20, f"Before. {item.replace(' ', '  ')}! After.")]
    got = find_contamination(make_docs(rows), bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in got) == [(20, 1, 0), (20, 1, 0), (20, 4, 0), (20, 4, 0)]
    assert rows[-1][1][got[0]["start"]: got[0]["stop"]] == item.replace(" ", "  ")
    left = drop_contaminated(make_docs(rows), bench)
    assert left.columns == make_docs([]).columns and left.count() == len(ODD_ROWS)
    assert find_contamination(make_docs([]), bench).collect() == []
    assert find_contamination(make_docs(rows), bench.limit(0)).collect() == []
