import pytest
from hypothesis import given
from hypothesis import strategies as st

from lexigrain.functions import text as T
from lexigrain.plans.lang import And, Leaf, Not, Or, QuerySyntaxError, UnsupportedQuery, complement, holds, leaves, lex, normalise, parse

a, b, c = (Leaf((w,)) for w in "abc")


def test_precedence_and_shape():
    assert parse("A & !(B | C)") == And((a, Not(Or((b, c)))))
    assert str(parse("A & !(B | C)")) == "(a & (! (b | c)))"
    assert parse("a | b & c") == Or((a, And((b, c))))
    assert parse("a & b & c") == And((a, b, c)) and parse("(a & b & c)") == And((a, b, c))
    assert parse("hello & !(goodbye | evening)") == And((Leaf(("hello",)), Not(Or((Leaf(("goodbye",)), Leaf(("evening",)))))))


def test_leaves():
    assert parse("of the and") == Leaf(("of", "the", "and"))
    assert parse("hello \\3 evening") == parse("hello /3 evening") == Leaf(("hello", "evening"), (3,))
    assert parse("a /1 b c") == Leaf(("a", "b", "c"), (1, 0))
    assert parse("re*ing").wildcard
    assert lex("a, b & (c)") == ["a", "b", "&", "(", "c", ")"]


@pytest.mark.parametrize("bad", ["", "!", "!!a", "(a", "a &", "a b /3", "a /3", "a /1 /2 b", "hello-world", "a)", "& a", "()", "a !b"])
def test_syntax_errors(bad):
    with pytest.raises(QuerySyntaxError):
        parse(bad)


def test_wildcard_stands_alone():
    with pytest.raises(UnsupportedQuery):
        parse("a re*")


nodes = st.recursive(st.sampled_from([a, b, c]), lambda x: st.one_of(x.map(Not), st.lists(x, min_size=2, max_size=3).map(lambda p: And(tuple(p))), st.lists(x, min_size=2, max_size=3).map(lambda p: Or(tuple(p)))), max_leaves=8)


@given(nodes, st.tuples(st.booleans(), st.booleans(), st.booleans()))
def test_normalise_keeps_meaning(node, values):
    truth = dict(zip([a, b, c], values))
    flat = normalise(node)
    assert holds(flat, truth) == holds(node, truth) and set(leaves(flat)) == set(leaves(node))
    assert complement(node) == holds(node, dict.fromkeys([a, b, c], False))

    def negations(n):
        return [n.of] if isinstance(n, Not) else [] if isinstance(n, Leaf) else [x for p in n.parts for x in negations(p)]

    assert all(isinstance(n, Leaf) for n in negations(flat))


@given(st.lists(st.integers(0, 2**40)))
def test_vbyte_round_trip(values):
    assert T.vbyte_decode(T.vbyte_encode(values)) == values


def test_codecs_and_splits():
    assert T.vbyte_encode([5, 130]) == bytes([0x85, 0x02, 0x81])
    assert T.delta([3, 7, 12]) == [3, 4, 5]
    assert T.contiguous_splits(list(range(7)), 3) == [[0, 1], [2, 3], [4, 5, 6]]
    assert T.range_delimiters(1) == [] and len(T.range_delimiters(4)) == 3 and T.range_delimiters(4) == sorted(T.range_delimiters(4))
    assert T.like_pattern("a_b*%") == "a\\_b%\\%"
    assert T.wildcard_trigrams("re*ing") == ["$re", "ing", "ng$"] and T.wildcard_trigrams("*a*") == []
    with pytest.raises(ValueError):
        T.vbyte_decode(b"\x01")
