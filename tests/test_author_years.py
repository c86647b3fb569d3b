"""Author-year citations of every pattern, their second authors, and which pattern claims a text."""

import pytest

from foliograph.operators import citations

REFS = ["Smith, J. and Jones, K. Title. 2009.", "Smith, J. Title. 2009.", "Lee, A. and Jones, K. Title. 2010.", "Lee, A. Title. 2010.", "de Bruin, B. Title. 2011a.", "Brown, C. Title. 2011a."]


def found(spark, body):
    refs = [(1, k, text, text[text.rindex(" ") + 1 : -1]) for k, text in enumerate(REFS, 1)]
    cited = citations.author_years(spark.createDataFrame([(1, body)], "doc_id long, body string"))
    rows = citations.claimed(citations.matched_authors(cited, spark.createDataFrame(refs, "doc_id long, ref_ord int, text string, year string")))
    return sorted((r.begin, r.author, r.year, r.ref_ord, r.confidence) for r in rows.collect())


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("(Smith and Jones, 2009)", [(1, "Smith", "2009", 1, 1.0)]),
        ("(Smith, 2009; Lee, 2010)", [(1, "Smith", "2009", 1, 1.0), (14, "Lee", "2010", 3, 1.0)]),
        ("Smith and Jones (2009)", [(0, "Smith", "2009", 1, 1.0)]),
        ("Lee & Jones (2010, pp. 3-4)", [(0, "Lee", "2010", 3, 1.0)]),
        ("Smith, Jones, and Lee (2009)", [(0, "Smith", "2009", 1, 1.0)]),
        ("(see Smith, Jones, and Lee, 2009)", [(5, "Smith", "2009", 1, 1.0)]),
        ("Smith, Jones et al. (2009)", [(7, "Jones", "2009", 1, 0.7)]),
        ("Lee's (2010)", [(0, "Lee", "2010", 3, 1.0)]),
        ("(de Bruin et al., 2011a,b; Lee and Nobody, 2010; among others)", [(1, "de Bruin", "2011a", 5, 1.0)]),
        ("Nobody and Lee (2010)", [(11, "Lee", "2010", 3, 1.0)]),
        ("Lee and Nobody (2010)", []),
        ("Nobody (1999)", []),
    ],
)
def test_patterns(spark, body, want):
    assert found(spark, body) == want
