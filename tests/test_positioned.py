"""Records of positioned text against plain Python that looks for each line's nearest anchor, and on made pages."""

import random
import re

from tests.compare import difference
from waymark.plans import catalog, landing
from waymark.sources import positioned

FOLDER = "/root/testdata/sf0.01"
ITEMS = "page long, x double, y double, text string"


def _read(spark, items):
    got = positioned.records(spark.createDataFrame(items, ITEMS), ["page"], landing._LABELS, landing._BANDS, ("plate", landing._PLATE), ["name"], extra_labels="^of the client$", missing=1)
    return sorted((r.page, r.record, r.plate, r.code, r.name, r.town) for r in got.collect())


def _plain(items):
    """Lines by gaps, bands from labels, each line to its nearest anchors: one page at a time."""
    out, names = [], list(landing._LABELS)
    items = [(p, x, y, t.strip()) for p, x, y, t in items if None not in (x, y, t) and t.strip()]
    for page in {i[0] for i in items}:
        lines = []
        for _, x, y, text in sorted((i for i in items if i[0] == page), key=lambda i: (-i[2], i[1], i[3])):
            if not lines or lines[-1][-1][1] - y > 2.0:
                lines.append([])
            lines[-1].append((x, y, text))
        at = {}
        for line in lines:
            for x, _, text in sorted(line):
                for n in names:
                    if re.search(landing._LABELS[n], text):
                        at.setdefault(n, x)
        bands = dict(landing._BANDS)
        if len(at) >= len(names) - 1:
            found = [n for n in names if n in at]
            for k, n in enumerate(found):
                bands[n] = ((at[found[k - 1]] + at[n]) / 2 if k else 0.0, (at[n] + at[found[k + 1]]) / 2 if k + 1 < len(found) else 9999.0)
        inside = lambda n, x: bands[n][0] <= x < bands[n][1]  # noqa: E731, B023
        label = "|".join([*landing._LABELS.values(), "^of the client$"])
        data = [(k + 1, max(y for _, y, _ in line), sorted((x, t) for x, _, t in line)) for k, line in enumerate(lines) if not any(re.search(label, t) for _, _, t in line)]
        anchors = [(k, y, [t for x, t in line if inside("plate", x) and re.search(landing._PLATE, t)][0], line) for k, y, line in data if any(inside("plate", x) and re.search(landing._PLATE, t) for x, t in line)]
        for k, y, plate, line in anchors:
            mine = [ln for _, ly, ln in data if abs(ly - y) <= min(abs(ly - a[1]) for a in anchors)]
            one = lambda n: next((t for x, t in line if inside(n, x)), "")  # noqa: E731, B023
            out.append((page, k, plate, one("code"), " ".join(t for ln in mine for x, t in ln if inside("name", x)), one("town")))
    return sorted(out)


def test_equals_sql_on_more_rows(spark):
    assert difference(catalog.queries()["positioned_records"](spark, FOLDER), catalog.oracle_sql()["positioned_records"], FOLDER) == ""


def test_pages_by_plain_python(spark):
    rng, items = random.Random(5), []
    for page in range(60):
        at = [10 + rng.randint(0, 5), 60 + rng.randint(0, 20), 120 + rng.randint(0, 60), 300 + rng.randint(0, 90)]
        heads = [h for h in ("Plate", "Code", "Name", "Town") if rng.random() < 0.85]
        items += [(page, float(at[["Plate", "Code", "Name", "Town"].index(h)]), 830.0 + rng.choice([0, 0.5]), h) for h in heads] + [(page, float(at[2]), 820.0, "of the client")]
        y = 800.0
        for _ in range(rng.randint(0, 8)):
            y -= rng.choice([6.0, 8.0, 10.0, 20.0])
            texts = [rng.choice(["ABC1D23", "XYZ9999", "no plate", None]), rng.choice(["77", " 8 ", ""]), rng.choice(["A B", "LONG  NAME", None]), rng.choice(["TOWN", "ABC1D23", None])]
            items += [(page, float(x) + rng.choice([0, 0.25, 4]), y - rng.choice([0, 0.5, 1.0]), t) for x, t in zip(at, texts)]
    items += [(99, None, 1.0, "ABC1D23"), (99, 1.0, None, "ABC1D23"), (98, 5.0, 5.0, "ABC1D23"), (98, 5.0, 5.0, "ABC1D23"), (None, 5.0, 5.0, "no record")]
    got, want = _read(spark, items), _plain([i for i in items if i[0] is not None])
    assert got == want and len(want) > 80


def test_a_line_in_the_middle_belongs_to_both_and_footers_to_the_last(spark):
    page = [(1, 10.0, 100.0, "ABC1D23"), (1, 120.0, 100.0, "ONE"), (1, 120.0, 90.0, "BOTH"), (1, 10.0, 80.0, "XYZ9999"), (1, 60.0, 80.0, "5"), (1, 120.0, 10.0, "FOOT"), (1, 60.0, 10.0, "6")]
    assert _read(spark, page) == [(1, 1, "ABC1D23", "", "ONE BOTH", ""), (1, 3, "XYZ9999", "5", "BOTH FOOT", "")]
    assert _read(spark, []) == []


def test_one_shuffle(spark):
    plan = positioned.records(spark.range(9).selectExpr("id % 3 as page", "id + 0.5D as x", "id + 0.5D as y", "string(id) as text"), ["page"], landing._LABELS, landing._BANDS, ("plate", landing._PLATE), ["name"])
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 1
