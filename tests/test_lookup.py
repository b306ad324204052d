"""Answers of a catalogue replayed from files, the gap between requests, and how candidates come out."""

from urllib.parse import quote_plus

import pytest

from bookspark.sources import catalogue, lookup


def test_replay(spark, tmp_path):
    path = lookup.search_path("The Tide", "Ann Reed", limit=99)
    assert path.endswith("limit=50") and lookup.search_path("x", isbn="978") == "search.json?isbn=978&limit=5"
    (tmp_path / (quote_plus(path) + ".json")).write_text('{"docs": [{"key": "/works/1", "title": "The Tide", "author_name": ["Ann Reed"]}, {"key": "/works/2", "title": "Tide"}, {"title": "no key"}]}')
    a = lookup.answers(spark, [path, "search.json?title=none"], replay=str(tmp_path))
    rows = {r.path: r for r in a.collect()}
    assert rows["search.json?title=none"].error == "no such answer" and rows[path].error is None
    found = catalogue.search(a.where("body is not null"), want_title="The Tide", want_author="Ann Reed").collect()
    assert [r.ref for r in found] == ["/works/1", "/works/2"] and found[0].score == 1.0
    with pytest.raises(ValueError):
        lookup.search_path()
    with pytest.raises(ValueError):
        lookup._Reader({"paths": "[]"})


def test_gap():
    now, slept = [0.0], []
    limiter = lookup.Limiter(clock=lambda: now[0], sleep=slept.append)
    limiter.wait()
    now[0] = 0.4
    limiter.wait()
    now[0] = 5.0
    limiter.wait()
    assert [round(s, 3) for s in slept] == [0.7]
