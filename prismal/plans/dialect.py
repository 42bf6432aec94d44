"""What both engines must round alike, and the tables that the SQL starts from."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Six digits, with an odd offset: results of few decimals never sit on the edge between two digits.
DIGITS, OFFSET = 1_000_000.0, 0.3217


def q(x: Column) -> Column:
    return F.floor(x * DIGITS + OFFSET) / DIGITS


def Q(x: str) -> str:
    return f"(floor(({x}) * {DIGITS} + {OFFSET}) / {DIGITS})"


PX = "px AS (SELECT vec_id AS pix, vec_id // 25 AS r, vec_id % 25 AS c, CAST(embedding AS DOUBLE[]) AS s, label = 0 AS gt, label FROM embeddings)"
PB = PX + ", pb AS (SELECT pix, unnest(s) AS v, generate_subscripts(s, 1) - 1 AS b FROM px)"
EP = "ep AS (SELECT l_partkey AS pix, CAST(year(l_shipdate) AS INTEGER) AS epoch, [avg(l_quantity) / 50, avg(l_extendedprice) / 100000, avg(l_discount) * 10, avg(l_tax) * 10] AS s FROM lineitem GROUP BY 1, 2)"
GR = "gr AS (SELECT o_orderkey AS pix, o_orderkey // 100 AS r, o_orderkey % 100 AS c, o_totalprice / 100000 AS score FROM orders)"
BANDS = "bands AS (SELECT CAST(i AS INTEGER) AS b, 400.0::DOUBLE + 33.0::DOUBLE * i AS wl FROM range(64) t(i))"


def dot(a: str, b: str) -> str:
    return f"list_sum([x * {b}[i] FOR x, i IN {a}])"


def inverse(ridge: str) -> str:
    """SQL: mu, sg (covariance), and inv(i, j, v) = inverse of covariance + ridge by Gauss-Jordan steps over pb."""
    return f"""
mu AS (SELECT b, avg(v) AS m FROM pb GROUP BY b),
ce AS (SELECT pb.pix, pb.b, pb.v - mu.m AS d FROM pb JOIN mu USING (b)),
sg AS (SELECT x.b AS i, y.b AS j, sum(x.d * y.d) / count(*) AS v FROM ce x JOIN ce y USING (pix) GROUP BY 1, 2),
tr AS (SELECT sum(v) AS t, count(*) AS n FROM sg WHERE i = j),
gj(k, i, j, v) AS (
  SELECT 0, i, j, v + CASE WHEN i = j THEN {ridge} ELSE 0 END FROM sg, tr
  UNION ALL SELECT 0, i, 64 + j, CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END FROM sg
  UNION ALL
  SELECT k + 1, i, j, CASE WHEN i = k THEN v / p ELSE v - vik * vkj / p END FROM (
    SELECT *, max(CASE WHEN i = k AND j = k THEN v END) OVER () AS p, max(CASE WHEN j = k THEN v END) OVER (PARTITION BY i) AS vik, max(CASE WHEN i = k THEN v END) OVER (PARTITION BY j) AS vkj FROM gj WHERE k < 64)
),
inv AS (SELECT i, j - 64 AS j, v FROM gj WHERE k = 64 AND j >= 64)"""
