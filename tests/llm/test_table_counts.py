"""Draws of table counts against plain Gibbs moves of single customers and against the recurrence."""

import numpy as np
import pytest

from tunelake.llm import pitman_yor_lm, table_counts


def moved(customers, strength, parent, discount, sweeps, rng):
    """Mean number of tables when each single customer leaves and sits down again."""
    sizes, found = [customers], []
    for _ in range(sweeps):
        for _ in range(customers):
            left = int(np.searchsorted(np.cumsum(sizes), rng.integers(customers), side="right"))
            sizes[left] -= 1
            if not sizes[left]:
                sizes.pop(left)
            ends = np.cumsum([*(n - discount for n in sizes), parent * (strength + discount * len(sizes))])
            table = int(np.searchsorted(ends, rng.random() * ends[-1], side="right"))
            if table == len(sizes):
                sizes.append(0)
            sizes[table] += 1
        found.append(len(sizes))
    return np.mean(found[sweeps // 10 :])


@pytest.mark.parametrize(("customers", "strength", "parent", "discount"), [(2, 3.0, 0.5, 0.4), (30, 5.0, 0.3, 0.6), (80, 20.0, 0.2, 0.75)])
def test_tables_as_from_single_moves(customers, strength, parent, discount):
    rng = np.random.default_rng(5)
    plain = moved(customers, strength, parent, discount, 20_000 // customers, rng)
    drawn = table_counts.drawn_tables(np.full(20_000, customers), np.full(20_000, strength), np.full(20_000, parent), discount, rng)
    assert drawn.mean() == pytest.approx(plain, rel=0.06)


@pytest.mark.parametrize("discount", [0.05, 0.5, 0.95])
def test_quadrature_as_recurrence(discount):
    c = table_counts.DIRECT
    t = np.arange(1.0, c + 1)
    ways = table_counts.log_coefficient(np.full(c, float(c)), t, discount)
    ways += table_counts.log_gamma(np.array(c + 1.0)) - table_counts.log_gamma(t + 1) - t * np.log(discount)
    assert ways == pytest.approx(table_counts.log_seatings(discount)[c], abs=1e-3)
    for strength, parent in ((1.0, 0.01), (50.0, 0.5), (1e5, 0.3)):
        chance = np.random.default_rng(3).random(200)
        every = np.full(200, strength), np.full(200, parent), discount, chance
        assert abs(table_counts.few(c, *every) - table_counts.many(np.full(200, c), *every)).max() <= 1


def test_sweep_reseats_hot_pairs():
    """20,000 customers of one pair: two sweeps leave the seating of its distribution, far from one table."""
    blob = pitman_yor_lm.blob
    one = (blob(np.array([9]), "<u8"), blob(np.array([1]), "<u4"), blob(np.array([3]), "<u2"), blob(np.array([20_000]), "<u4"))
    other = np.zeros(pitman_yor_lm.CONTEXTS)
    other[3] = 1001  # a thousand tables of other dishes
    shared = pitman_yor_lm.Shared(
        tokens=40_000, words=1000, discount=0.75, customers=other, tables=[other, other],
        parent_customers=[10.0] * 2, parent_tables=[4.0] * 2,
    )
    (first, *_), _ = pitman_yor_lm.Bucket(0, *one).states(shared, 2)
    above = pitman_yor_lm.parent_probability(shared, 0, np.ones(1), np.ones(1))
    expected = table_counts.drawn_tables(np.full(300, 20_000), np.full(300, 751.0), np.full(300, above[0]), 0.75, np.random.default_rng(1))
    assert expected.mean() > 20
    assert abs(first[0] - expected.mean()) < 5 * expected.std()
