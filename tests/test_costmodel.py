import random

from hypothesis import given, settings
from hypothesis import strategies as st

from stratum.operators import search
from stratum.operators.costmodel import Layout, TableLoad, cost, expand


def load(size=100.0, columns=4, targets=None, loc=None, freq=None):
    targets = targets or {"q": frozenset({0, 2})}
    return TableLoad(size, columns, targets, loc or {q: {0: frozenset({2, 3})} for q in targets}, freq or dict.fromkeys(targets, 1.0))


def test_worked_example():
    one = load()
    assert cost(one, Layout(0)).size == 100
    assert cost(one, Layout(0, frozenset({1, 3}))).size == 20
    got = cost(one, Layout(0, frozenset({1, 3}), frozenset({0, 1, 2})))
    assert (got.size, got.block_num, got.partition_num) == (10, 2, 12)
    assert expand(one, Layout(0, frozenset({1, 3}), frozenset({0, 1, 2})), "q") == ([2, 3], [0, 2])


def test_no_sort_key_or_unknown_blocks_read_everything():
    assert cost(load(), Layout(None, frozenset({5}))).size == 100
    assert cost(load(), Layout(3, frozenset({5}))).size == 100


def test_two_queries_add_up():
    two = load(targets={"a": frozenset({0}), "b": frozenset({3})}, loc={"a": {1: frozenset({1})}, "b": {1: frozenset({10})}}, freq={"a": 0.5, "b": 0.5})
    assert abs(cost(two, Layout(1, frozenset({5}))).size - 50) < 1e-9


loads = st.builds(
    lambda seed: (lambda r: TableLoad(50.0, 4, {q: frozenset(r.sample(range(4), r.randint(1, 3))) for q in "ab"}, {q: {k: frozenset(r.sample(range(1, 6), r.randint(1, 4))) for k in range(4)} for q in "ab"}, {"a": 0.7, "b": 0.3}, 5))(random.Random(seed)),
    st.integers(0, 10**6),
)


@settings(max_examples=60, deadline=None)
@given(loads, st.integers(0, 3), st.sets(st.integers(1, 4)), st.sets(st.integers(0, 2)), st.integers(1, 4))
def test_a_cut_never_costs(table, key, rows, cols, extra):
    before = cost(table, Layout(key, frozenset(rows), frozenset(cols))).size
    assert cost(table, Layout(key, frozenset(rows | {extra}), frozenset(cols))).size <= before + 1e-9


@settings(max_examples=25, deadline=None)
@given(loads, st.integers(2, 6))
def test_greedy_is_close_to_the_optimum(table, budget):
    best, found = cost(table, search.exhaustive(table, budget)).size, cost(table, search.greedy(table, budget)).size
    assert best - 1e-9 <= found <= 1.6 * best + 1e-9


def test_actions_follow_the_budget():
    one = load()
    assert search.actions(one, Layout(), 0) == [("sort", c) for c in range(4)]
    first = search.actions(one, Layout(0), 1)
    assert None not in first and len(first) == 9 + 3
    later = search.actions(one, Layout(0, frozenset({1})), 2)
    assert later.count(None) == 1 and ("row", 1) not in later
    env = search.Environment({"t": one})
    before = env.layouts["t"]
    _, got, done = env.step("t", ("sort", 0))
    assert got == 0 and not done and before.sort_key is None and env.layouts["t"].sort_key == 0
    assert len(search.state(one, Layout(0))) == 2 * 4 - 1 + 9 + 1 and search.action_vector(one, None).sum() == 0
