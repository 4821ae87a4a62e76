"""The eleven flight-delay reports. Where one joins two groupings of which the second is unique by key, the join is an ordinary one."""

from __future__ import annotations

from brindle.plans.sqlquery import Catalogue

C = Catalogue()
QUERIES, SQL = C.queries, C.sql

_YEARS = "flight_year BETWEEN 2002 AND 2008"


def _late_share(where: str) -> str:
    """Carriers with the share of their flights that left more than ten minutes late."""
    return f"""SELECT carrier, c, c2, CAST(c * 100 AS DOUBLE) / c2 AS c3 FROM (SELECT carrier, COUNT(*) AS c FROM ontime WHERE depdelay > 10 AND {where} GROUP BY carrier) a
JOIN (SELECT carrier, COUNT(*) AS c2 FROM ontime WHERE {where} GROUP BY carrier) b USING (carrier) ORDER BY c3 DESC, carrier"""


C.both("ontime_q0", "SELECT ROUND(AVG(c1), 6) AS avg_flights FROM (SELECT flight_year, flight_month, COUNT(*) AS c1 FROM ontime GROUP BY flight_year, flight_month) a")
C.both("ontime_q1", f"SELECT dayofweek, COUNT(*) AS c FROM ontime WHERE {_YEARS} GROUP BY dayofweek ORDER BY c DESC, dayofweek")
C.both("ontime_q2", f"SELECT dayofweek, COUNT(*) AS c FROM ontime WHERE depdelay > 10 AND {_YEARS} GROUP BY dayofweek ORDER BY c DESC, dayofweek")
C.both("ontime_q3", f"SELECT origin, COUNT(*) AS c FROM ontime WHERE depdelay > 10 AND {_YEARS} GROUP BY origin ORDER BY c DESC, origin LIMIT 10")
C.both("ontime_q4", "SELECT carrier, COUNT(*) AS c FROM ontime WHERE depdelay > 10 AND flight_year = 2007 GROUP BY carrier ORDER BY c DESC, carrier")
C.both("ontime_q5", _late_share("flight_year = 2007"))
C.both("ontime_q6", _late_share(_YEARS))
C.both("ontime_q7", """SELECT flight_year, CAST(c1 AS DOUBLE) / c2 AS rate FROM (SELECT flight_year, COUNT(*) * 100 AS c1 FROM ontime WHERE depdelay > 10 GROUP BY flight_year) a
JOIN (SELECT flight_year, COUNT(*) AS c2 FROM ontime GROUP BY flight_year) b USING (flight_year) ORDER BY flight_year""")
C.both("ontime_q8", f"SELECT destcityname, COUNT(DISTINCT origincityname) AS u FROM ontime WHERE {_YEARS} GROUP BY destcityname ORDER BY u DESC, destcityname LIMIT 10")
C.both("ontime_q9", "SELECT flight_year, COUNT(*) AS c1 FROM ontime GROUP BY flight_year")
C.both("ontime_q10", """SELECT MIN(flight_year) AS first_year, MAX(flight_year) AS last_year, carrier, COUNT(*) AS cnt, SUM(CAST(arrdelayminutes > 30 AS INT)) AS flights_delayed, ROUND(CAST(SUM(CAST(arrdelayminutes > 30 AS INT)) AS DOUBLE) / COUNT(*), 2) AS rate
FROM ontime WHERE dayofweek NOT IN (6, 7) AND originstate NOT IN ('AK', 'HI', 'PR', 'VI') AND deststate NOT IN ('AK', 'HI', 'PR', 'VI') AND flightdate < DATE '2010-01-01'
GROUP BY carrier HAVING COUNT(*) > 100 AND MAX(flight_year) > 1990 ORDER BY rate DESC, carrier LIMIT 1000""",
"""SELECT MIN(flight_year) AS first_year, MAX(flight_year) AS last_year, carrier, COUNT(*) AS cnt, CAST(SUM(CAST(arrdelayminutes > 30 AS INT)) AS BIGINT) AS flights_delayed, ROUND(CAST(SUM(CAST(arrdelayminutes > 30 AS INT)) AS DOUBLE) / COUNT(*), 2) AS rate
FROM ontime WHERE dayofweek NOT IN (6, 7) AND originstate NOT IN ('AK', 'HI', 'PR', 'VI') AND deststate NOT IN ('AK', 'HI', 'PR', 'VI') AND flightdate < DATE '2010-01-01'
GROUP BY carrier HAVING COUNT(*) > 100 AND MAX(flight_year) > 1990 ORDER BY rate DESC, carrier LIMIT 1000""")  # fmt: skip
