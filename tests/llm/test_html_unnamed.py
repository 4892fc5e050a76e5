"""Pages whose article and main tags are taken off keep the text that the named pages have."""

import os
import re
from collections import Counter

import pyarrow.parquet as pq
import pytest

from pixelweave.llm import html_text

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.mark.skipif(not os.path.exists(PAGES), reason="needs the test tables")
def test_unnamed_pages():
    pages = [x or "" for x in pq.read_table(PAGES, columns=["html"]).column(0).to_pylist()]
    counts = Counter()
    for page in pages:
        counts.update(html_text.tag_counts(page) or {})
    weight = html_text.weights({k: (counts[k, True], counts[k, False]) for k in {k for k, _ in counts}})
    for page in pages:
        bare = re.sub(r"</?(?:article|main)\b[^>]*>", "", page, flags=re.I)
        assert html_text.main_text(bare, weight) == html_text.main_text(page, weight)
