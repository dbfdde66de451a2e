"""Headers go through the YAML library's C parser; what that rejects is decided by the other."""

from __future__ import annotations

import pytest

from lorewright.functions import pages

yaml = pytest.importorskip("yaml")
HEADERS = ["a: 1", "a: [x, 'y, z']\nb: {c: [d]}", "a: >-\n  b\n  c", "a: [", "a: b: c", "- x", "", "a: \"\\U0001f600\"", "a: ~\nb: 2024-01-01", "? x", "a: 'it''s'", "\ta: 1", "a: *b", "a: 1\na: 2", "a: !!int 3"]


@pytest.mark.parametrize("header", HEADERS)
def test_same_as_the_other_parser(header):
    try:
        want = yaml.load(header + "\n", Loader=yaml.BaseLoader)
    except yaml.YAMLError:
        want = None
    assert pages._yaml(header + "\n") == want


@pytest.mark.skipif(not yaml.__with_libyaml__, reason="no C parser")
def test_good_headers_take_the_c_parser(monkeypatch):
    asked, load = [], yaml.load
    monkeypatch.setattr(yaml, "load", lambda text, Loader: asked.append(Loader) or load(text, Loader=Loader))
    assert pages.full_header("---\ntitle: a\n---\nb") == {"title": "a"} and asked == [yaml.CBaseLoader]
