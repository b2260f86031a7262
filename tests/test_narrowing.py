"""Manifests narrowed as text."""

from paramlens.sources import narrowing

TEXT = """# a run
sfd:
  manifest: {params: no}
  params:  # what is drawn
    C: [0.1, 1, 10]  # strength
    solver: ['a, b', "lbfgs", saga]

    flag: [true, 1, null]
    depth:
      - 3   # shallow
      # a note that stays
      - 5
    fixed: 7
uel:
  params:
    C: [1, 2]
"""


def test_lists_are_cut_and_all_else_stays():
    out, problems = narrowing.narrowed(TEXT, {"C": [10, 0.1], "solver": ["a, b"], "flag": [True], "depth": [5]})
    assert problems == []
    assert out == TEXT.replace("[0.1, 1, 10]", "[0.1, 10]").replace("""['a, b', "lbfgs", saga]""", "['a, b']").replace("[true, 1, null]", "[true]").replace("      - 3   # shallow\n", "")


def test_what_cannot_be_done_is_told():
    out, problems = narrowing.narrowed(TEXT, {"C": [3], "none": [1], "fixed": [7], "solver": [], "flag": [None]})
    assert problems == ["C has no value 3", "none is not a parameter", "fixed is not written as a list", "solver would have no values"]
    assert out == TEXT.replace("[true, 1, null]", "[null]")
    assert narrowing.narrowed("x: 1", {"C": [1]}) == ("x: 1", ["C is not a parameter"])


def test_tokens():
    assert narrowing.split_list("1, [2, 3], 'x, y', ") == ["1", "[2, 3]", "'x, y'", ""] and narrowing.split_list("") == []
    assert [narrowing.scalar(t) for t in ("1", "1.5", "~", "True", "'it''s'", '"a\\n"', "word")] == [1, 1.5, None, True, "it's", "a\n", "word"]
