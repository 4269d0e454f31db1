"""License notices back to back."""

import pytest

from marketgrid.llm import licenses


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
@pytest.mark.parametrize("between", ["", "pkg: ", "one two three: ", "a b c d e f g h i j k l: "])
@pytest.mark.parametrize("times", [1, 2, 3, 12])
def test_notices_back_to_back(name, between, times):
    """Every notice is found at its own place, as a plain search for the text finds it."""
    notice = licenses.TEMPLATES[name]
    text = " ".join(between + notice for _ in range(times))
    want, at = [], text.find(notice)
    while at >= 0:
        want.append((name, 1.0, at, at + len(notice.rstrip("."))))
        at = text.find(notice, at + 1)
    assert licenses.Index.build(licenses.TEMPLATES).matches(text) == want


def test_different_notices_side_by_side():
    own = licenses.TEMPLATES
    names = ["MIT", "CC-BY-4.0", "MIT", "Apache-2.0", "CC-BY-4.0", "CC-BY-4.0", "MIT"]
    got = licenses.Index.build(own).matches(" ".join(own[n] for n in names))
    assert [m[0] for m in got] == names


def test_notice_inside_another():
    """The longer match stays, and the words around it make no match across it."""
    got = licenses.Index.build(licenses.TEMPLATES).matches("Released under Licensed under CC BY-NC 4.0 the MIT License")
    assert [m[0] for m in got] == ["CC-BY-NC-4.0"]


def changed(own):
    """The words with each one replaced, left out, doubled, or followed by a strange word."""
    for k in range(len(own)):
        for middle in (["zzz"], [], [own[k]] * 2, [own[k], "zzz"]):
            yield own[:k] + middle + own[k + 1:]


@pytest.mark.parametrize("name", sorted(licenses.TEMPLATES))
def test_every_change_of_one_word(name):
    """What a plain alignment of all templates with the whole text finds, the index finds."""
    index = licenses.Index.build(licenses.TEMPLATES)
    for text in changed(licenses.words(licenses.TEMPLATES[name])):
        covered = [licenses.align(t, text, -len(t), len(text))[0] for t in index.templates]
        most = max((c for c, t in zip(covered, index.templates) if c >= licenses.COVERAGE * len(t)), default=0)
        got = index.matches(" ".join(["before", *text, "after"]))
        sizes = dict(zip(index.names, map(len, index.templates)))
        assert max((round(share * sizes[n]) for n, share, _, _ in got), default=0) == most, text


def test_changes_up_to_the_coverage():
    """As many words spread over a template as its coverage allows: it is a candidate still."""
    index = licenses.Index.build(licenses.TEMPLATES)
    for name, own in zip(index.names, index.templates):
        lost = int(len(own) * (1 - licenses.COVERAGE) + 1e-9)
        text = list(own)
        for k in range(lost):
            text[(k + 1) * len(own) // (lost + 1)] = f"zzz{k}"
        assert name in [m[0] for m in index.matches(" ".join(text))], text


def test_words_that_are_no_notice():
    """Two common words start an alignment, but no match."""
    index = licenses.Index.build(licenses.TEMPLATES)
    assert index.matches("the film was released under the name of its author and the mit keeps a copy") == []
    assert index.matches("under the " * 5_000) == []
    far = "a b c d e f g h"
    for text in (f"released {far} under the mit license", f"released under the mit {far} license"):
        got = index.matches(text)
        assert [(m[0], m[1]) for m in got] == [("MIT", 0.8)] and far not in text[got[0][2]:got[0][3]]
