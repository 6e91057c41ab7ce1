"""Character references (S3) against the standard library's reading of the HTML standard."""

import html
import random

from pyspark.sql import functions as F

from chunkmill.sources.extract import decode_entities, html_to_text

CASES = [None, "", "plain", "&", "&&amp;", "a &amp; b &lt;c&gt; &quot;q&quot; &#39;s&#39;", "&notit; &notin; &not &nosuch; &ampx", "&copy2024 &COPY;",
         "&#0; &#x80; &#128; &#x9f; &#13; &#xD800; &#x110000; &#99999999999999999999; &#x0000000041; &#65 &#65a", "&#xFDD0;&#xFFFF;&#x1FFFE;&#1;&#11;&#127;",
         "&#; &#x; &#xg &; & x &#x1F600;", "&CounterClockwiseContourIntegral;&NotEqualTilde;&acE;", "&" + "a" * 40 + ";", "&été;", "tail &am"]


def test_references_match_the_standard(spark):
    rng = random.Random(5)
    names = sorted(html.entities.html5)
    cases = CASES + ["&" + n + rng.choice(["", ";", "x", " ", "&", "="]) for n in names]
    cases += [f"&#{rng.choice(['', 'x', 'X'])}{rng.choice(['', '0'])}{n};" for n in [*range(0, 260), 55295, 57344, 64975, 65008, 131070, 1114111, 1114112]]
    cases += ["".join(rng.choice("&#;xX aA19ltgmpno\n") for _ in range(30)) for _ in range(500)]
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    for r in df.select("t", decode_entities("t").alias("d")).collect():
        assert r.d == (None if r.t is None else html.unescape(r.t)), r.t


def test_html_text_needs_no_python(spark):
    df = spark.createDataFrame([("<p>a &amp; b</p><p> c&nbsp;&eacute;</p>",), ("<b>none</b>",)], "t string").select(html_to_text(F.col("t")).alias("x"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
    assert sorted(r.x for r in df.collect()) == ["a & b c é", "none"]
