"""Contexts under a budget: what is kept, how it is shrunk, and that nothing costs more than it may."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators import assembly as A
from tidemark.operators.compress import estimate
from tidemark.operators.packing import PER_MESSAGE, PRIMING


def block(content="", role="user", priority=0, pin=False, evict="truncate", keep="head", images=0, turns=None):
    return {"role": role, "content": content, "priority": priority, "pin": pin, "evict": evict, "keep": keep, "images": images, "turns": turns}


def turns(*texts):
    return [{"role": "user", "content": t} for t in texts]


any_block = st.builds(
    block, st.text(max_size=300), st.sampled_from(["system", "user", "tool"]), st.integers(0, 10), st.booleans(), st.sampled_from(["truncate", "compress", "drop_oldest", "odd"]),
    st.sampled_from(["head", "tail"]), st.integers(0, 1), st.none() | st.lists(st.text(max_size=60), max_size=5).map(lambda t: turns(*t)),
)


@settings(max_examples=250, deadline=None)
@given(st.lists(any_block, max_size=6), st.integers(1, 500), st.integers(0, 100))
def test_the_budget_is_never_exceeded_and_the_receipt_adds_up(blocks, budget, reserve):
    got = A.assemble(blocks, budget, reserve, image_tokens=20)
    assert got["used"] <= max(0, budget - reserve) and got == A.assemble(blocks, budget, reserve, image_tokens=20)
    if got["overflow"] is None:
        assert sorted(d[0] for d in got["decisions"]) == list(range(len(blocks)))
        images = sum(20 for i, _, action, *_ in got["decisions"] if action == "kept" and blocks[i]["turns"] is None and blocks[i]["images"])
        text = sum(estimate(t) + PER_MESSAGE for _, t in got["messages"])
        assert got["used"] == (text + images + PRIMING if got["messages"] else 0)
    else:
        assert any(b["pin"] for b in blocks) and got["messages"] == []


def test_strategies_shrink_and_say_so():
    long = "One sentence stands here. Another one says more about budgets and budgets. " * 20
    actions = lambda b, budget=60, **k: [d[2:] for d in A.assemble([b], budget, **k)["decisions"]][0]
    assert actions(block(long))[0] == "truncated" and actions(block(long, evict="compress"))[0] == "compressed"
    assert actions(block(long, evict="drop_oldest"))[0] == "dropped" and actions(block(long, evict="odd"))[3] == "unknown strategy 'odd'"
    assert actions(block("x", images=1), image_tokens=100)[3] == "images: too large" and actions(block(long), 5)[3] == "no room (framing)"
    own = {"mine": A.summarizing(lambda text, target: "short"), "bad": A.summarizing(lambda text, target: 1 / 0)}
    assert actions(block(long, evict="mine"), strategies=own)[0] == "summarized" and "ZeroDivisionError" in actions(block(long, evict="bad"), strategies=own)[3]
    text = A.assemble([block(long, keep="tail")], 60)["messages"][0][1]
    assert text.startswith(A.MARKS["tail"]) and long.endswith(text.removeprefix(A.MARKS["tail"]))
    assert "pinned block 0" in A.assemble([block(long, pin=True)], 20)["overflow"]


def test_histories_keep_the_newest_turns():
    got = A.assemble([block(turns=turns("old " * 40, "newer", "newest"))], 40)
    assert [t for _, t in got["messages"]] == ["newer", "newest"] and got["decisions"][0][2] == "truncated" and got["decisions"][0][5] == "history: kept 2 of 3 turns"
    got = A.assemble([block(turns=turns("word " * 100))], 40)
    assert got["messages"][0][1].startswith(A.MARKS["tail"]) and got["used"] <= 40
    assert A.assemble([block(turns=turns("word " * 100), evict="drop_oldest")], 40)["decisions"][0][2] == "dropped"
    assert A.assemble([block(turns=[])], 40)["decisions"][0][2] == "kept"


def test_columns_of_blocks(spark):
    rows = [(1, [block("hi", "user"), block("be kind", "system", pin=True)]), (2, []), (3, None)]
    df = spark.createDataFrame(rows, f"id int, b {A.BLOCKS}")
    got = {r.id: r.a for r in df.select("id", A.assembled("b", 50).alias("a")).collect()}
    assert [m.role for m in got[1].messages] == ["system", "user"] and got[1].overflow is None
    assert got[2].messages == [] and got[2].used == 0 and got[3] is None
    with pytest.raises(Exception):  # noqa: B017, PT011
        df.select(A.assembled("missing", 5)).collect()
