import random

import pytest

from cardwright.llm import line_dedup as line_dedup_module
from cardwright.llm.line_dedup import line_dedup
from tests.llm.conftest import ODD_ROWS


def brute(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        lines = (rows[i][1] or "").split("\n")
        gone = set()
        for p in range(len(lines) - 2):
            window = tuple(lines[p: p + 3])
            if window in seen:
                gone |= {p, p + 1, p + 2}
            seen.add(window)
        out[rows[i][0]] = (0 if rows[i][1] is None else len(lines), len(gone), rows[i][1] if not gone else "\n".join(x for p, x in enumerate(lines) if p not in gone))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(make_docs, seed):
    rng = random.Random(seed)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "", "dd"]) for _ in range(rng.randint(0, 9)))) for i in range(60)]
    passage = "\n".join(f"license line {k}" for k in range(8))
    rows += [(100 + i, f"own {i}\n{passage}\nend {i}") for i in range(30)] + [(500, "x\n" * 50)]
    got = {r["doc_id"]: (r["n_lines"], r["n_removed"], r["text"]) for r in line_dedup(make_docs(rows)).collect()}
    assert got == brute(rows)
    assert got[100][1] == 0 and got[101] == (10, 8, "own 1\nend 1")


def test_odd_rows(make_docs):
    got = line_dedup(make_docs(ODD_ROWS)).collect()
    assert len(got) == len(ODD_ROWS) and all(r["n_removed"] == 0 for r in got)
    assert [r["text"] for r in got if r["doc_id"] == 2] == [None]
    twice = [(1, "a\nb\nc")] * 2 + [(1, "x\na\nb\nc")]
    assert sorted((r["n_removed"], r["text"]) for r in line_dedup(make_docs(twice)).collect()) in (
        [(0, "a\nb\nc"), (0, "a\nb\nc"), (3, "x")], [(0, "x\na\nb\nc"), (3, ""), (3, "")])
    assert line_dedup(make_docs([])).collect() == []


def test_a_hot_window_is_split(spark, make_docs, monkeypatch):
    """The join's final plan deals a window that most texts hold out to several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "8k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.files.maxPartitionBytes": "32k",
    }
    before = {k: spark.conf.get(k) for k in settings}
    real, plans = line_dedup_module.materialise, []

    def watched(df, name, *more):
        if name == "covered-lines":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name, *more)

    monkeypatch.setattr(line_dedup_module, "materialise", watched)
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = [(i, "same one\nsame two\nsame three" if i % 8 else f"own {i}\n\nother {i}") for i in range(20_000)]
        got = line_dedup(make_docs(rows).repartition(24)).filter("n_removed > 0").count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == 20_000 * 7 // 8 - 1 and "skew=true" in plans[0]
