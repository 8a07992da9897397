"""Script blocks: the published case and the parts of a line."""

from pyspark.sql import functions as F

from spanloom.functions import text as T


def blocks(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [[tuple(b) for b in r["b"]] for r in df.select("i", T.script_blocks(F.col("t")).alias("b")).orderBy("i").collect()]


def test_published_script(spark):
    script = (
        "---\ntitle: Wi-Fi 感測技術\nauthor: Tech Team\n---\n# 第一段：開場\n標題：不用攝影機也能穿牆看見你？\n主題：無線訊號感測\n大綱：介紹原理與隱私影響\n內文：\n（鏡頭拉近）\n"
        "1. 你有想過家裡的無線路由器，其實可以變成隱形雷達嗎？\n內文：當無線電波在房間裡反射時，人體移動會改變訊號相位。\n"
    )
    ((one, two),) = blocks(spark, script)
    assert one[0] == "你有想過家裡的無線路由器，其實可以變成隱形雷達嗎？" and two[0] == "當無線電波在房間裡反射時，人體移動會改變訊號相位。"


def test_lines(spark):
    got = blocks(spark, "---\na: b\n...\nspoken words", "---\nnever closed\nlost words", "　 >-12. BODY: Say (aside) THIS [cue] now\r\n***\n#no\nNotes: none\nabc\nVO:\n()", None, "", "-- not front matter\n--- \nlast line here", "（一）（二）三四五六", "nested (a (b) c) words")
    assert got[0] == [("spoken words", "spokenwords")] and got[1] == [] and got[3] == [] and got[4] == []
    assert got[2] == [("Say (aside) THIS [cue] now", "saythisnow")]
    assert got[5] == [("not front matter", "notfrontmatter"), ("last line here", "lastlinehere")]
    assert got[6] == [("（一）（二）三四五六", "三四五六")] and got[7] == [("nested (a (b) c) words", "nestedcwords")]


def test_lines_are_read_once(spark, capsys):
    """Lines are split in one place of the plan of each query, and a listing needs no shuffle."""
    from spanloom.plans import catalog

    for name in ("script_blocks_parse", "script_listing"):
        catalog.queries()[name](spark, "/root/testdata/sf0.001").explain()
        plan = capsys.readouterr().out
        assert plan.count("split(") == 1 and "Exchange" not in plan, name
