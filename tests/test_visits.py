"""Two-sided visits against plain Python and on made rows."""

from tests.compare import difference
from waymark.operators.visits import two_sided_visits
from waymark.plans import catalog

M = 1 / 111_195  # degrees of a metre on a meridian
PLAN = "delivery long, vehicle long, lat double, lng double"
STOPS = "stop_id long, vehicle long, start long, end long, kind string, lat double, lng double"


def _got(spark, plan, stops, told=None):
    told = None if told is None else spark.createDataFrame(told, "delivery long, arrive long, leave long")
    out = two_sided_visits(spark.createDataFrame(plan, PLAN), spark.createDataFrame(stops, STOPS), ["vehicle"], told)
    return {r.delivery: (r.stop_id, r.arrive, r.leave, round(r.dist), r.via) for r in out.collect()}


def test_equals_sql_on_more_rows(spark):
    for name in ("visits_of_both_sides", "lent_neighbour_visits"):
        assert difference(catalog.queries()[name](spark, "/root/testdata/sf0.01"), catalog.oracle_sql()[name], "/root/testdata/sf0.01") == ""


def test_choices_of_both_sides(spark):
    plan = [(1, 7, 0.0, 0.0), (2, 7, 400 * M, 0.0), (3, 7, 3000 * M, 0.0), (4, 7, 3700 * M, 0.0), (5, 7, 4450 * M, 0.0), (6, 8, 0.0, 0.0), (7, 7, None, 0.0), (8, None, 0.0, 0.0), (9, 7, 9000 * M, 0.0)]
    stops = [
        (10, 7, 100, 200, "STORE", 190 * M, 0.0), (11, 7, 300, 900, "STORE", 10 * M, 0.0), (12, 7, 1000, 2600, "OUTSIDE", -600 * M, 0.0),  # wide and longest: the near one wins
        (13, 7, 50, 9000, "BASE", 0.0, 0.0), (14, 7, 5000, 5500, "OUTSIDE", 3000 * M, 0.0), (15, 7, 6000, 6500, "OUTSIDE", 3001 * M, 0.0),  # equally long: the first
        (16, 7, 1, 2, "STORE", None, 0.0), (17, None, 1, 2, "STORE", 0.0, 0.0), (18, 7, 7000, None, "STORE", 9600 * M, 0.0),
    ]
    got = _got(spark, plan, stops)
    assert got[1] == (11, 300, 900, 10, "own")  # stop 10 went to delivery 1, too, and is shorter
    assert got[2] == (11, 300, 900, 400, "lent")
    assert got[3] == (14, 5000, 5500, 0, "own") and got[4] == (14, 5000, 5500, 700, "lent")
    assert 5 not in got  # its neighbour only borrowed
    assert got[9] == (18, 7000, 7000, 600, "wide") and set(got) == {1, 2, 3, 4, 9}
    told = _got(spark, plan, stops, [(1, None, 5), (3, 8, 9), (7, 1, 2), (99, 1, 2)])
    assert 1 not in told and told[2] == got[2] and told[3] == (None, 8, 9, 0, "told") and told[7] == (None, 1, 2, 0, "told") and 99 not in told
    assert _got(spark, [], stops) == _got(spark, plan, []) == {}
