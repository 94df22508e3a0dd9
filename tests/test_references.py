"""Character references in SQL against the standard library's decoder."""

import html as standard
import random
from html.entities import html5

from pyspark.sql import functions as F

from showloom.functions import html


def test_references_equal_the_standard_decoder(spark):
    random.seed(7)
    texts = [f"a&{n}b &{n} &{n[:-1]}x;" for n in html5] + [f"&#{n};&#x{n:X}z&#{n}" for n in [*range(0, 300), 0xD7FF, 0xD800, 0xDFFF, 0xE000, 0xFDD0, 0xFFFD, 0xFFFE, 0x1F600, 0x1FFFF, 0x10FFFF, 0x110000, 10**9, 10**30]]
    parts = ["&", "&amp", "&amp;", "amp;", "&#", "&#x", "&#38;", "&#0000000038;", "&#x26;lt;", "&lt", "&notit;", "&notin;", "&NotEqualTilde;", "&frac12", "&frac1", ";", " ", "\n", "x", "é", "😀", "#", "<", "&unknown;", "&" + "y" * 40 + ";", "&CounterClockwiseContourIntegral;"]
    texts += ["".join(random.choices(parts, k=random.randrange(9))) for _ in range(3000)] + ["", None, "plain"]
    rows = spark.createDataFrame([*enumerate(texts)], "i int, t string")
    for r in rows.select("i", html.unescape(F.col("t")).alias("x")).collect():
        text = texts[r["i"]]
        assert r["x"] == (None if text is None else standard.unescape(text)), text
