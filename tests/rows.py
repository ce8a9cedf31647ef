"""Small operations tables made by rule, for the tests."""

import datetime

COLUMNS = (
    "location_id string, location_name string, region string, month date, revenue double, "
    "budget_revenue double, labor_expense double, other_expense double, volume double"
)


def clean(locations: int = 15, months: int = 12) -> list[tuple]:
    rows = []
    for place in range(1, locations + 1):
        for month in range(1, months + 1):
            revenue = 100000.0 + 1000 * place + 10 * month + 0.25
            rows.append(
                (
                    f"LOC-{place:03d}",
                    f"Place {place}",
                    f"Region {place % 4}",
                    datetime.date(2025, month, 1),
                    revenue,
                    revenue - 50 * (place - 8),
                    30000.0 + place,
                    40000.0 + month,
                    float(1000 + place * month),
                )
            )
    return rows


def table(spark, rows, columns=COLUMNS):
    return spark.createDataFrame(rows, columns)


def as_csv(rows, header=None, extra=()):
    names = header or [c.split()[0] for c in COLUMNS.split(", ")]
    lines = [",".join(names)]
    for row in rows:
        lines.append(",".join("" if v is None else str(v) for v in row))
    return "\n".join([*lines, *extra]) + "\n"
