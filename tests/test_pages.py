"""Web pages to lines, and sections, on small texts."""

from pyspark.sql import functions as F

from partloom.functions import lines as L, rules, text as T
from partloom.sources import pages as G


def one(spark, column, *values):
    return spark.createDataFrame([(v,) for v in values], "v string").select(column(F.col("v"))).collect()


def test_pages_show_their_blocks_as_lines(spark):
    html = '<html><HEAD><title>A &amp; B</title><style>p{x}</style></head><body><!-- <p>no --><script>var t="</p>";</script><h1>C</h1><p>d <b>e</b>&nbsp;f<br/>g &amp;lt; h</p></body>'
    assert [x for x in one(spark, G.html_text, html)[0][0].split("\n") if x.strip()] == ["A & B", "C", "d e f", "g &lt; h"]
    assert one(spark, G.html_text, None)[0][0] is None and one(spark, G.html_text, "")[0][0] == ""


def test_sections_follow_headings(spark):
    text = "before\n\nAPPLICATION\n INTERCHANGE \na: 1\nAPPLICATION\nx\ny"
    got = one(spark, G.sections, text, "", None)
    assert [tuple(x) for x in got[0][0]] == [("", "before\n"), ("INTERCHANGE", "a: 1"), ("APPLICATION", "x\ny")]
    assert [tuple(x) for x in got[1][0]] == [("", "")] and got[2][0] is None


def test_blocks_and_entries(spark):
    texts = ["gamma\nModel 2.0L 1999-2003", "OMC Engine\n- Inboard &\nV-Drive\nBig Block V8 5.7L 1990-1999", "Volvo\nBosch: 123 | Delco: 45\nFan Type\nInternal\nPenta 2.5L 2001-2002;; Tamd", "YouTech : 123456\nsomething", "1999-2000 only"]
    df = spark.createDataFrame(list(enumerate(texts)), "key int, text string")
    got = sorted(map(tuple, L.application_blocks(df, "key", "text", rules.ATTRIBUTE_NAMES).collect()))
    assert got == [(0, "Gamma", "Model", "2.0L", "1999-2003"), (1, "Omc Engine - Inboard & V-Drive", "Big Block", "V8 5.7L", "1990-1999"), (2, "Volvo", "Penta", "2.5L", "2001-2002"), (2, "Volvo", "Tamd", "", "")]
    assert [r[0] for r in one(spark, T.title_case, "mañana o'NEIL", "école 2x")] == ["Mañana O'Neil", "École 2X"]
