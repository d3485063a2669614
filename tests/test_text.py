"""Scalar functions on small literal cases."""

import pytest
from pyspark.sql import functions as F

from stepweave.functions import nested
from stepweave.functions import text as tx
from stepweave.functions.nested import CONDITIONS
from stepweave.plans.bindings import DIMS


@pytest.fixture(scope="module")
def over(spark):
    """over(values, function) -> the function's values on a column of texts."""

    def run(values, function):
        df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
        return [r[0] for r in df.orderBy("i").select(function(F.col("t"))).collect()]

    return run


def test_junk(over):
    lines = ["short", "See also our other pages on this", "Whisk the eggs until they are smooth.", "  notes :  ", "Other Great Recipes for everyone here", "  ab cdefghijkl ", "Try: this one too, it is good"]
    assert over(lines, tx.is_junk) == [True, True, False, True, True, True, True]


def test_unicode_space(over):
    assert over(["  a  b "], tx.canonical_action) == ["a_b"]
    assert over(["  Whisk   the EGGS "], tx.normal_phrase) == ["whisk the eggs"]


@pytest.mark.parametrize(("text", "want"), [("cook to 70 C", [70.0]), ("62°C then 62 C", [62.0]), ("140 F", [140.0]), ("for 90 or 0.95", []), ("150C, 10 °c", [150.0, 10.0]), (None, [])])
def test_temperatures(over, text, want):
    assert over([text], tx.temperatures) == [want]


def test_mentions_of_times_and_heat(over):
    assert over(["on low heat at 70 C for 2 minutes, constantly"], tx.temperature_mentions) == [["70 C", "low heat"]]
    assert over(["on low heat for 2 minutes, constantly, 1 hr"], tx.time_mentions) == [["1 hr", "2 minutes", "constantly"]]


def test_whole_words(over):
    terms = ["cream", "água", "half-and-half", "c.d"]
    assert over(["add the cream", "creamy eggs", "ÁGUA!", "some half-and-half", "c.d", "cxd"], lambda t: tx.mentioned(t, terms)) == [["cream"], [], ["água"], ["half-and-half"], ["c.d"], []]
    extra = F.array(F.lit("Foo Bar"), F.lit("x\\Ey"), F.lit(""))
    assert over(["a foo bar x\\Ey", "foobar"], lambda t: tx.mentioned(t, [], extra)) == [["foo bar", "x\\ey"], []]


def test_thermal_and_compound(over):
    assert over(["cook eggs", "cooking eggs", "melted butter", "Heat the pan", "saute"], tx.is_thermal) == [True, False, False, True, False]
    assert over(["crack and whisk", "whisk eggs", "pour, then stir", "sand"], tx.may_be_compound) == [True, False, True, False]
    assert over(["serve"], lambda t: tx.may_be_compound(t, ["serve"])) == [True]


def test_ground_span(spark):
    rows = [("don't stir", "Please don’t stir it.", "don’t stir"), ("stir", "stir it", "stir"), ("absent", "text", "absent"), ('say "x-y"', "I say “x–y” now", "say “x–y”")]
    df = spark.createDataFrame(rows, "s string, t string, want string")
    assert df.filter(tx.ground_span(F.col("s"), F.col("t")) != F.col("want")).isEmpty()


def test_labels(over):
    known = {"soft_curd": "coagulating", "raw": "liquid", "cooked through": "solid"}
    states = ["Raw", "soft curd", "Soft-Curd", "cooked through", "very firm now", "burnt edges", "nothing known", "whisked and set"]
    assert over(states, lambda s: tx.compile_label(s, known)) == ["liquid", "coagulating", "coagulating", "solid", "solid", "scorched", "liquid", "liquid"]


def test_fingerprint_is_the_digest_of_its_parts(spark):
    import hashlib

    got = spark.range(1).select(tx.fingerprint(F.lit("Process"), F.lit(" Whisk  Eggs "), F.lit("egg:liquid"), F.lit(""))).first()[0]
    assert got == hashlib.sha256(b"Process|whisk_eggs|egg:liquid|").hexdigest()[:16]


def test_ratios(spark):
    row = spark.range(1).select(tx.percent(F.lit(1), F.lit(0)), tx.percent_or_zero(F.lit(0), F.lit(0)), *tx.precision_recall_f1(F.lit(0), F.lit(1), F.lit(1)), *tx.precision_recall_f1(F.lit(1), F.lit(1), F.lit(0))).first()
    assert tuple(row) == (None, 0.0, 0.0, 0.0, None, 0.5, 1.0, pytest.approx(2 / 3))


def test_pair_of_a_node_with_itself_is_refused(spark):
    with pytest.raises(Exception, match="paired with itself"):
        spark.range(1).select(tx.pair_id(F.lit("a"), F.lit("a"))).collect()


def conditions(*pairs):
    return F.array(*[F.struct(F.lit(e).alias("entity_id"), F.lit(s).alias("physics_state"), F.lit(k).alias("k2_label")) for e, s, k in pairs]).cast(CONDITIONS)


def test_conditions(spark):
    c = conditions(("Small-Bolt", "raw", "liquid"), ("bolt", "runny", "liquid"), ("gear", "set", "solid"), ("", "x", "solid"), ("rod", "x", "odd"))
    row = spark.range(1).select(nested.clean_conditions(c, DIMS.alias_map()).alias("c"), nested.conditions_key(conditions(("b", "", "solid"), ("a", "", "liquid"))).alias("k")).first()
    assert [(x.entity_id, x.physics_state, x.k2_label) for x in row.c] == [("bolt", "raw", "liquid"), ("gear", "set", "solid")]
    assert row.k == "a:liquid|b:solid"


def test_invented_temperatures(spark):
    texts = F.array(F.lit("at 80 C"), F.lit("62 C is known"), F.lit("90 alone"), F.lit("55C"))
    row = spark.range(1).select(nested.invented_temperatures(F.lit(99.0), texts, F.lit("stay below 55 °C"), DIMS.known_temperatures)).first()
    assert row[0] == [99.0, 80.0]


def test_scope_issues_name_outsiders(spark):
    out = nested.outside_entities(conditions(("sea salt", "", "solid")), conditions(("bolt", "", "solid")), F.array(F.lit("gear")), F.array(F.lit("measuring_cup")), DIMS.alias_map(), list(DIMS.inventory))
    row = spark.range(1).select(out.alias("o"), nested.scope_issues(F.lit("Fill the measuring cup, gizmo"), out, list(DIMS.known_out)).alias("i")).first()
    assert row.o == ["sea salt", "measuring_cup"] and row.i == ["gizmo", "measuring cup"]
