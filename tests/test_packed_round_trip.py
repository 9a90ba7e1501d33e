"""Packed fields made from known items come apart into these items."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.operators import packed

_SPECIAL = set(packed.SPECIAL)
CHAR = st.sampled_from("abcXYZ019师范类+&.-·")
WORD = st.text(CHAR, min_size=1, max_size=6)
ITEM = st.one_of(WORD, st.tuples(WORD, WORD).map(" ".join), st.tuples(WORD, st.sampled_from("/、,"), WORD).map("".join))


def take_apart(value: str) -> list[str]:
    """The operator's own steps: tokens, skeleton, rule, positions."""
    tokens = re.findall("[" + re.escape(packed.SPECIAL) + "]|[^" + re.escape(packed.SPECIAL) + "]+", value)
    skeleton = "".join(t if t in _SPECIAL else packed.MASK for t in tokens)
    return ["".join(tokens[a:a + n]) for a, n in packed.resolve(skeleton)]


@given(st.lists(ITEM, min_size=2, max_size=8), st.sampled_from([",", "，", "、", ";", "；", "|", "｜", "/", "／", "\t", "\n", ", ", " | ", " ", "  "]), st.sampled_from(['""', "''", "“”", "「」"]), st.booleans())
@settings(max_examples=400, deadline=None)
def test_round_trip(items, delimiter, marks, all_quoted):
    blank = delimiter.strip(" ") == ""
    cells = []
    for item in items:
        divides = any(c in packed.DELIMITERS for c in item) or blank and " " in item
        cells.append(f"{marks[0]}{item}{marks[1]}" if divides or all_quoted else item)
    assert take_apart(delimiter.join(cells)) == items
    assert take_apart(f"  {delimiter.join(cells)}  ") == items


@given(st.text(st.sampled_from("ab ,;'\"“”、/\t"), max_size=40))
@settings(max_examples=300, deadline=None)
def test_any_text_keeps_its_letters(value):
    items = take_apart(value)
    letters = lambda s: re.sub(r"[^ab]", "", s)
    assert letters("".join(items)) == letters(value)
    assert all(i and i == i.strip(" ") for i in items)
