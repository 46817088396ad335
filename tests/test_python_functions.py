import numpy as np
from pyspark.sql import functions as F

from threadloom.functions import python as px
from threadloom.operators import small


def test_text(spark):
    df = spark.createDataFrame([("Él niño", "“Yes” – it is so", '"Yes" - it'), (None, None, None)], "a string, o string, p string")
    got = [tuple(r) for r in df.select(px.strip_diacritics("a"), px.prefix_length("o", "p")).collect()]
    assert got == [("El nino", 10), (None, None)]
    spans = spark.createDataFrame([("ab cd ef" * 3,), ("",)], "t string").select(px.chunk_spans(F.col("t"), F.lit(10), F.lit(4)).alias("s")).collect()
    s = [(x.start, x.stop) for x in spans[0].s]
    assert s[0][0] == 0 and s[-1][1] == 24 and all(a[1] == b[0] and a[1] - a[0] <= 10 for a, b in zip(s, s[1:])) and spans[1].s == []


def test_nearest_message(spark):
    m = spark.createDataFrame([(1, 0, "good morning"), (1, 1, "the tram was late"), (1, 2, None)], "c int, message_index int, content string")
    q = spark.createDataFrame([(1, "tram was latte")], "c int, quote string")
    assert px.nearest_message(m, q, ["c"]).first().message_index == 1


def test_margins(spark):
    pages = spark.createDataFrame([(1, k, f"Head\nbody {k}\nHead\nfoot {k}") for k in range(4)] + [(2, 0, "Head\nx")], "doc_id int, page int, text string")
    got = {(r.doc_id, r.page): r.text for r in px.without_margins(pages).collect()}
    assert got[1, 2] == "body 2\nHead\nfoot 2" and got[2, 0] == "Head\nx"


def test_leaf_order_and_packing():
    x = np.array([[0.0], [10.0], [0.1], [10.1], [5.0]])
    for method in ("ward", "average"):
        order = small.leaf_order(x, method)
        assert sorted(order) == list(range(5)) and abs(order.index(0) - order.index(2)) == 1 and abs(order.index(1) - order.index(3)) == 1
    assert small.leaf_order(np.empty((0, 2))) == [] and small.packed([5, 9, 3, 2], 10) == [True, False, True, True]
