import random

import pytest

from cardwright.llm import source_mix
from cardwright.llm.source_mix import bucket_digits, edf_period, mix_plan, mix_sources
from tests.llm.conftest import ODD_ROWS


def test_every_deadline_of_a_period_is_met():
    random.seed(3)
    for _ in range(200):
        w = {f"s{k}": random.randint(1, 9) for k in range(random.randint(1, 8))}
        period, slots = sum(w.values()), edf_period(w)
        assert sorted(x for v in slots.values() for x in v) == list(range(period))
        for s, v in slots.items():
            assert all(i * period // w[s] <= x < -(-(i + 1) * period // w[s]) for i, x in enumerate(v))


def test_shares_stay_within_a_block(make_docs):
    rows = [(i, "t", None, random.Random(i).choice("aaaaabbc")) for i in range(1500)]
    weights = {"a": 3, "b": 2, "c": 1, "*": 1}
    got = sorted(mix_sources(make_docs(rows), weights, block_docs=4).collect(), key=lambda r: r["mix_position"])
    assert [r["mix_position"] for r in got] == list(range(1500)) and {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert all(r["mix_release"] <= r["mix_slot"] < r["mix_deadline"] for r in got)
    phase0 = [r for r in got if r["mix_phase"] == 0]
    slots = {r["mix_slot"]: r["mix_group"] for r in phase0}
    done = dict.fromkeys("abc", 0)
    for slot in range(len(slots)):
        done[slots[slot]] += 1
        assert all(abs(done[g] - weights[g] / 6 * (slot + 1)) < 1 for g in "abc")


def test_odd_rows_all_get_a_place(make_docs):
    got = mix_sources(make_docs(ODD_ROWS), {"a": 2}, block_docs=2).collect()
    assert sorted(r["mix_position"] for r in got) == list(range(len(ODD_ROWS)))
    assert {r["mix_group"] for r in got} == {"a", "*"}
    assert mix_sources(make_docs([]), {"a": 2}).collect() == []


def test_weights_are_checked(make_docs):
    for bad in ({"a": 0}, {"a": 10**6}):
        with pytest.raises(ValueError):
            mix_sources(make_docs([]), bad)


def slot_by_slot(rows, weights, block_docs):
    """(source, block) in order: of the released blocks the one that is due first, a phase for each set of sources left."""
    left = {s: -(-n // block_docs) for s, n in rows.items() if n}
    out, done = [], dict.fromkeys(left, 0)
    while left:
        live, before, now = list(left), dict(done), 0
        period = sum(weights[s] for s in live)
        while len(left) == len(live):
            due = []
            for s in left:
                i = done[s] - before[s]
                if i * period // weights[s] <= now:
                    due.append((-(-(i + 1) * period // weights[s]), s))
            s = min(due)[1]
            out.append((s, done[s]))
            done[s] += 1
            left[s] -= 1
            left = {s: n for s, n in left.items() if n}
            now += 1
    return out


def test_plans_against_a_schedule_slot_by_slot():
    rng = random.Random(5)
    for _ in range(150):
        names = [f"s{k}" for k in range(rng.randint(1, 7))]
        weights = {s: rng.choice([1, 2, 3, 4, 6, 100, 200]) for s in names}
        rows = {s: rng.choice([0, 1, 5, 40, 300]) for s in names}
        placed = {}
        for e in mix_plan(rows, weights, 4):
            for block in range(e["from_block"], e["to_block"]):
                turn, k = divmod(block - e["from_block"], e["weight"])
                placed[e["base"] + turn * e["period"] + e["slots"][k]] = (e["g"], block)
        assert [placed[x] for x in sorted(placed)] == slot_by_slot(rows, weights, 4) and sorted(placed) == list(range(len(placed)))


def test_a_thousand_sources_of_weight_100(make_docs):
    rows = [(i, "t", None, f"s{i % 1000 if i < 1500 else i * i % 300}") for i in range(4000)]
    got = mix_sources(make_docs(rows), {f"s{k}": 100 for k in range(1000)}, block_docs=2)
    assert len(got._jdf.queryExecution().toString()) < 1 << 20
    assert sorted(r["mix_position"] for r in got.select("mix_position").collect()) == list(range(4000))
    many = {f"s{k}": 80_000 + 997 * k for k in range(1000)}
    entries = list(mix_plan(many, dict.fromkeys(many, 100), 8))
    assert {e["weight"] for e in entries} == {1} and sum(e["to_block"] - e["from_block"] for e in entries) == sum(-(-n // 8) for n in many.values())


def test_plans_that_are_not_broadcast_place_rows_alike(make_docs, monkeypatch):
    docs = make_docs([(i if i % 3 else None, f"t{i}", None, random.Random(i).choice("aaaaabbc")) for i in range(900)])
    weights = {"a": 3, "b": 2, "c": 1}
    assert [bucket_digits(n) for n in (0, 10**8, 10**9, 10**11)] == [3, 3, 4, 5]
    want = sorted(mix_sources(docs, weights, block_docs=4).collect(), key=repr)
    monkeypatch.setattr(source_mix, "PLAN_BYTES", -1)
    monkeypatch.setattr(source_mix, "STRETCH", 7)
    monkeypatch.setattr(source_mix, "BUCKET_ROWS", 10**-6)
    assert bucket_digits(900) == 7 and sorted(mix_sources(docs, weights, block_docs=4).collect(), key=repr) == want
