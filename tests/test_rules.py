import random

from planloom.operators import rules as L
from planloom.staging import Stage


def applies(conditions, facts):
    """The stated rule: each condition that the context knows something about has one of the context's values."""
    return all(k not in facts or facts[k] is None or set(v) & set(facts[k]) for k, v in (conditions or {}).items())


def test_match_contexts_equals_a_check_of_every_pair(spark):
    rng = random.Random(8)
    keys, values = ["type", "subdomain", "action", "near", "space"], ["a", "b", "c"]
    some = lambda: rng.sample(values, rng.randint(1, 2))
    rules = [(k, {key: some() for key in rng.sample(keys + ["other"], rng.randint(0, 4))}) for k in range(40)] + [(98, {}), (99, None)]
    contexts = [(f"c{k}", {key: (None if rng.random() < 0.1 else some() if rng.random() < 0.3 else [rng.choice(values)]) for key in rng.sample(keys, rng.randint(0, 5))}) for k in range(60)]
    contexts += [("none", None), ("empty list", {"type": []})]
    c = spark.createDataFrame(contexts, "context string, facts map<string,array<string>>")
    r = spark.createDataFrame(rules, "rule int, conditions map<string,array<string>>")
    got = {(x.context, x.rule) for x in L.match_contexts(c, r, Stage(spark, "t")).collect()}
    assert got == {(n, k) for n, f in contexts for k, cond in rules if applies(cond, f or {})}
    assert L.match_contexts(c, r.limit(0), Stage(spark, "t")).count() == L.match_contexts(c.limit(0), r, Stage(spark, "t")).count() == 0


def test_repeated_rows_stay_and_unknown_types_meet_all_rules(spark):
    elements = spark.createDataFrame([(1, "duct", "hvac"), (1, "duct", "hvac"), (2, None, "hvac"), (3, "pipe", None)], "id int, element_type string, element_subdomain string")
    rules = L.rule_table(spark, [dict(rule_name="d", element_types=["duct"], subdomain="hvac"), dict(rule_name="d", element_types=["duct"], subdomain="hvac"), dict(rule_name="p", element_types=["pipe"], subdomain="plumbing"), dict(rule_name="all")])
    got = sorted((r.id, r.rule_name) for r in L.applicable_rules(elements, rules).collect())
    assert got == sorted([(1, "d")] * 4 + [(1, "all")] * 2 + [(2, "d")] * 2 + [(2, "all")] + [(3, "p"), (3, "all")])
