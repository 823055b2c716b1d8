"""The alignment of many children is that of few: exact, whatever their number."""

import random

from termforge.llm import html_extraction as H


def node(label, kids=()):
    return [label, 0, 1, False, 0, 0, list(kids)]


def tree(r, depth):
    return node(r.choice("pqd"), [tree(r, depth - 1) for _ in range(r.randrange(3))] if depth else ())


def test_wide_nodes_are_aligned_as_narrow_ones(monkeypatch):
    r = random.Random(4)
    for _ in range(40):
        a, b = node("x", [tree(r, 2) for _ in range(r.randrange(1, 30))]), node("x", [tree(r, 2) for _ in range(r.randrange(1, 30))])
        monkeypatch.setattr(H, "_WIDE", 1 << 40)
        want = H.simple_tree_match(a, b)
        monkeypatch.setattr(H, "_WIDE", 0)
        assert H.simple_tree_match(a, b) == want


def test_more_than_a_million_pairs():
    """Before, a child more than 64 places on was never found, and matched children counted as one node each."""
    ad, post = node("ad"), node("post", [node("p"), node("p")])
    left, right = node("x", [post] * 1100), node("x", [ad] * 100 + [post] * 1100)
    n, pairs = H.simple_tree_match(left, right)
    assert n == 1 + 3 * 1100 and pairs == [(i, i + 100) for i in range(1100)]
