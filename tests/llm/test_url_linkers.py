"""Distrust of linkers: how many others link to a blocked host changes no verdict."""

from __future__ import annotations

import pytest

from terrane.llm import url_filters as U


@pytest.mark.parametrize("linkers", [1, 2, 3, 40])
def test_every_linker_of_a_blocked_host_is_blocked(spark, linkers):
    rows = [(0, "http://bad.net/es/1", "")] + [(k, f"http://linker{k}.org/", '<a href="http://bad.net/es/1">') for k in range(1, linkers + 1)]
    rows += [(100, "http://mixed.org/", '<a href="http://bad.net/es/1"><a href="http://a.com/"><a href="http://b.com/">'), (101, "http://a.com/", ""), (102, "http://b.com/", "")]
    got = {r.page_id: r.verdict for r in U.judge_pages(spark.createDataFrame(rows, "page_id long, url string, html string"), U.RULES).collect()}
    assert [k for k in range(1, linkers + 1) if got[k] != "block"] == []
    assert got[100] == got[101] == got[102] == "allow"
