from planloom.operators import texts as X


def test_intent_shuffles_no_text_and_lowers_it_once(spark):
    rows = [(1, "Show the VAV, the duct"), (2, "Show the VAV, the duct"), (3, None), (4, "nothing"), (5, "vav vavs panel")]
    out = X.classify_intent(spark.createDataFrame(rows, "id long, text string"), [("hvac", "vav", 3.0, "equipment"), ("hvac", "duct", 2.5, None), ("electrical", "panel", 2.5, "devices")],
                            {"query": ["show"], "create": ["draw"]}, {"autocad": ["dwg"], "revit": ["rvt"]}).drop("text")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "first(text" not in plan and "contains(lower" not in plan.lower()
    assert {r.id: (r.domain, r.subdomain, r.action) for r in out.collect()} == {
        1: ("hvac", "equipment", "query"), 2: ("hvac", "equipment", "query"), 3: ("general", None, "query"), 4: ("general", None, "query"), 5: ("hvac", "equipment", "query")}
