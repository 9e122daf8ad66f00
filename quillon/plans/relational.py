"""Relational queries as SQL text that Spark (after ``rewrite``) and any other engine run alike; ``{name}`` marks a table."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from quillon.plans.sqltext import rewrite
from quillon.sources.connectors import table

SQL = {
    # scans, projection, predicates
    "s1_scan": "SELECT * FROM {nation}",
    "s2_projection": "SELECT o_orderkey, o_totalprice FROM {orders}",
    "p2_alias": "SELECT c_custkey AS id, c_name AS name FROM {customer}",
    "p3_qualified": "SELECT nation.n_name, nation.n_regionkey FROM {nation} nation WHERE nation.n_nationkey < 10",
    "p4_expression": "SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM {lineitem}",
    "p5_comparison": "SELECT o_orderkey FROM {orders} WHERE o_totalprice >= 200000.0 AND o_orderstatus <> 'F' AND o_orderkey != 7",
    "p6_column_column": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE l_suppkey > l_partkey",
    "p7_between": "SELECT o_orderkey FROM {orders} WHERE o_totalprice BETWEEN 1000.0 AND 50000.0 AND o_custkey NOT BETWEEN 10 AND 100",
    "p8_in_list": "SELECT c_custkey FROM {customer} WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey NOT IN (1, 2, 3)",
    "p9_like": "SELECT p_partkey FROM {part} WHERE p_type LIKE 'PROMO%' AND p_name NOT LIKE '%_1'",
    "p10_ilike": "SELECT p_partkey FROM {part} WHERE p_type ILIKE 'promo%' AND p_brand NOT ILIKE '%z%'",
    "p11_null": "SELECT x.t IS NULL AS missing, x.t IS NOT NULL AS present, count(*) AS n, count(x.t) AS counted, count(CASE WHEN x.t > 0 THEN 1 END) AS more, count(CASE WHEN NOT x.t > 0 THEN 1 END) AS less FROM (SELECT nullif(l_tax, 0.02) AS t FROM {lineitem}) x GROUP BY x.t IS NULL, x.t IS NOT NULL",
    "p12_and_or": "SELECT l_orderkey, l_linenumber FROM {lineitem} WHERE (l_returnflag = 'R' OR l_quantity > 45) AND (l_linestatus = 'O' OR (l_discount > 0.05 AND l_tax < 0.03))",
    "p13_not": "SELECT o_orderkey FROM {orders} WHERE NOT (o_orderstatus = 'F' OR o_totalprice < 100000.0)",
    "p14_in_subquery": "SELECT o_orderkey FROM {orders} WHERE o_custkey IN (SELECT c_custkey FROM {customer} WHERE c_acctbal < 0) AND o_custkey NOT IN (SELECT c_custkey FROM {customer} WHERE c_nationkey = 3)",
    "p15_scalar_subquery": "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) FROM {orders})",
    "p16_exists": "SELECT o_orderkey FROM {orders} o WHERE EXISTS (SELECT * FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 49)",
    "p16_not_exists": "SELECT o_orderkey FROM {orders} o WHERE NOT EXISTS (SELECT * FROM {lineitem} l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 40)",
    "p17_correlated_scalar": "SELECT p_partkey FROM {part} p WHERE p_retailprice > (SELECT avg(q.p_retailprice) FROM {part} q WHERE q.p_brand = p.p_brand)",
    "p18_case": "SELECT l_returnflag, count(CASE WHEN l_quantity < 10 THEN 1 WHEN l_quantity < 20 THEN NULL ELSE 1 END) AS n, round(sum(CASE WHEN l_discount > 0.05 THEN l_extendedprice ELSE 0 END), 2) AS big FROM {lineitem} GROUP BY l_returnflag",
    "p19_case_columns": "SELECT count(CASE WHEN l_returnflag = l_linestatus THEN 1 END) AS same, count(CASE WHEN l_returnflag <> l_linestatus THEN 1 END) AS other FROM {lineitem}",
    # joins
    "j1_hash_join": "SELECT o_orderkey, c_name FROM {orders} JOIN {customer} ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "j2_theta_join": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM {nation} a JOIN {nation} b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey AND b.n_nationkey >= 5",
    "j3_comma_join": "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem}, {part} WHERE (p_partkey = l_partkey AND p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 21 AND p_size BETWEEN 1 AND 25) OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 30 AND p_size BETWEEN 1 AND 40)",
    "j4_self_join": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM {supplier} a JOIN {supplier} b ON a.s_nationkey = b.s_nationkey WHERE a.s_suppkey < b.s_suppkey",
    "j6_semi_join": "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT * FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "j6_anti_join": "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT * FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    "j8_multi_join": "SELECT r_name, count(*) AS n FROM {region} JOIN {nation} ON n_regionkey = r_regionkey JOIN {customer} ON c_nationkey = n_nationkey JOIN {orders} ON o_custkey = c_custkey GROUP BY r_name",
    "j9_outer_joins": "SELECT c.c_custkey AS c, o.o_orderkey AS o FROM (SELECT * FROM {customer} WHERE c_nationkey < 5) c FULL OUTER JOIN (SELECT * FROM {orders} WHERE o_totalprice > 300000.0) o ON c.c_custkey = o.o_custkey",
    "j11_grouped_join": "SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey GROUP BY n_name",
    "j2_pure_theta": "SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM {nation} a JOIN {supplier} b ON b.s_acctbal > a.n_nationkey * 350 AND b.s_nationkey <> a.n_nationkey",
    "j9_left_join": "SELECT c_custkey, o_orderkey FROM {customer} LEFT JOIN {orders} ON c_custkey = o_custkey AND o_totalprice > 250000.0",
    "j9_right_join": "SELECT s_suppkey, n_nationkey FROM {supplier} RIGHT JOIN {nation} ON s_nationkey = n_nationkey AND s_acctbal > 3000.0",
    "j9_cross_join": "SELECT r_name, n_name FROM {region} CROSS JOIN {nation}",
    # aggregation
    "a1_count": "SELECT count(*) AS count FROM {lineitem}",
    "a2_count_column": "SELECT count(l_returnflag) AS n FROM {lineitem} WHERE l_quantity > 25",
    "a3_sum": "SELECT CAST(sum(CAST(o_custkey AS DOUBLE)) AS DOUBLE) AS s, round(sum(o_totalprice), 2) AS t FROM {orders}",
    "a3_sum_empty": "SELECT sum(o_totalprice) AS s, avg(o_totalprice) AS a, count(*) AS n FROM {orders} WHERE o_orderkey < 0",
    "a4_average": "SELECT round(avg(l_quantity), 6) AS q, round(avg(l_extendedprice), 4) AS p FROM {lineitem}",
    "a5_min_max": "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderpriority) AS first_text, max(o_orderpriority) AS last_text FROM {orders}",
    "a6_argument_expression": "SELECT round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(sum(-l_quantity + 2 * l_tax), 2) AS odd, round(sum(l_quantity / nullif(l_tax, 0)), 2) AS ratio FROM {lineitem}",
    "a8_group_by": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_orderstatus, o_orderpriority",
    "a8_group_only": "SELECT c_nationkey, c_mktsegment FROM {customer} GROUP BY c_nationkey, c_mktsegment",
    "a10_having": "SELECT l_suppkey, count(*) AS n FROM {lineitem} GROUP BY l_suppkey HAVING count(*) > 600",
    "a11_distinct": "SELECT count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_returnflag) AS flags FROM {lineitem}",
    "a11_select_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM {orders}",
    "a12_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(grouping(o_orderstatus) AS BIGINT) AS g FROM {orders} GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "a12_grouping_sets": "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM {lineitem} GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_linenumber), ())",
    "a14_statistics": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS deviation, round(var_pop(l_discount), 8) AS variance, round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS high, round(median(l_tax), 4) AS middle, count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 25) AS suppliers FROM {lineitem} GROUP BY l_returnflag",
    "a12_rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM {lineitem} GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "a13_over_aggregates": "SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM {lineitem} JOIN {part} ON l_partkey = p_partkey",
    # sort and limit
    "o1_order_hidden": "SELECT o_orderkey FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "o2_order_ordinal": "SELECT c_nationkey, c_custkey FROM {customer} ORDER BY 1 DESC, 2 LIMIT 15",
    "o3_order_aggregate": "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 10",
    "o5_limit_offset": "SELECT p_partkey FROM {part} ORDER BY p_retailprice DESC, p_partkey LIMIT 7 OFFSET 5",
    # set operations
    "u1_union": "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 5000.0 UNION SELECT s_nationkey AS k FROM {supplier}",
    "u2_intersect": "SELECT c_nationkey AS k FROM {customer} INTERSECT SELECT s_nationkey AS k FROM {supplier} WHERE s_acctbal > 0",
    "u3_except": "SELECT n_nationkey AS k FROM {nation} EXCEPT SELECT s_nationkey AS k FROM {supplier} WHERE s_acctbal > 5000.0",
    "u1_union_all": "SELECT c_nationkey AS k FROM {customer} WHERE c_acctbal > 8000.0 UNION ALL SELECT s_nationkey AS k FROM {supplier}",
    "u2_intersect_all": "SELECT c_nationkey AS k FROM {customer} INTERSECT ALL SELECT s_nationkey AS k FROM {supplier}",
    "u3_except_all": "SELECT c_nationkey AS k FROM {customer} EXCEPT ALL SELECT s_nationkey AS k FROM {supplier}",
    # windows
    "w1_row_number": "SELECT o_custkey, o_orderkey, n FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS n FROM {orders}) x WHERE n <= 3",
    "w2_ranks": "SELECT c_custkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS BIGINT) AS quarter, round(percent_rank() OVER w, 8) AS p, round(cume_dist() OVER w, 8) AS c FROM {customer} WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_mktsegment)",
    "w3_lag_lead": "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2, -1) OVER w AS after, first_value(event_type) OVER w AS first_type FROM {events} WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
    "w4_running": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4) AS so_far FROM {events}",
    "w5_range_frame": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_custkey RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING) AS near FROM {orders}",
    "w6_share": "SELECT l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 8) AS share FROM {lineitem}",
    "w7_over_groups": "SELECT o_orderpriority, o_orderstatus, count(*) AS n, CAST(rank() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC) AS BIGINT) AS place FROM {orders} GROUP BY o_orderpriority, o_orderstatus",
    # scalar functions
    "f1_date_interval": "SELECT o_orderkey FROM {orders} WHERE o_orderdate >= DATE '1996-01-31' + INTERVAL '1' MONTH AND o_orderdate < DATE '1997-01-31' - INTERVAL '10' DAY",
    "f2_strings": "SELECT c_custkey, upper(c_mktsegment) AS up, substring(c_name, 1, 8) AS head, CAST(length(c_name) AS INTEGER) AS n FROM {customer}",
    "f3_cast_coalesce": "SELECT l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS q, coalesce(NULL, l_tax, 0) AS t FROM {lineitem}",
    "f3_math": "SELECT o_orderkey, round(sqrt(o_totalprice), 6) AS root, round(ln(o_totalprice), 8) AS log, CAST(floor(o_totalprice / 7) AS BIGINT) AS low, CAST(ceil(o_totalprice / 7) AS BIGINT) AS high, abs(o_custkey - 700) AS far, CAST(o_orderkey % 7 AS BIGINT) AS rest, round(power(o_custkey, 1.5), 4) AS grown FROM {orders}",
    "f4_conditionals": "SELECT l_orderkey, l_linenumber, coalesce(nullif(l_returnflag, 'N'), 'none') AS flag, greatest(l_discount, l_tax) AS high, least(l_discount, l_tax) AS low, CAST(l_quantity AS VARCHAR(20)) LIKE '1%' AS one FROM {lineitem}",
    # benchmark queries
    "q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM {lineitem} WHERE l_shipdate <= DATE '2001-09-02' GROUP BY l_returnflag, l_linestatus",
    "q2": "SELECT s_acctbal, s_name, n_name FROM {supplier}, {nation}, {region} WHERE s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND s_acctbal = (SELECT max(x.s_acctbal) FROM {supplier} x, {nation} y WHERE x.s_nationkey = y.n_nationkey AND y.n_regionkey = r_regionkey)",
    "q3": "SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM {customer}, {orders}, {lineitem} WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "q4": "SELECT o_orderpriority, count(*) AS order_count FROM {orders} WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-07-01' + INTERVAL '3' MONTH AND EXISTS (SELECT * FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_tax < l_discount) GROUP BY o_orderpriority",
    "q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer}, {orders}, {lineitem}, {supplier}, {nation}, {region} WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' GROUP BY n_name",
    "q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-01-01' + INTERVAL '1' YEAR AND l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24",
    "q7": "SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INTEGER) AS l_year, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {supplier}, {lineitem}, {orders}, {customer}, {nation} n1, {nation} n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND ((n1.n_nationkey = 6 AND n2.n_nationkey = 7) OR (n1.n_nationkey = 7 AND n2.n_nationkey = 6)) GROUP BY n1.n_name, n2.n_name, CAST(year(l_shipdate) AS INTEGER)",
    "q8": "SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum(CASE WHEN n_nationkey = 3 THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS mkt_share FROM {part}, {supplier}, {lineitem}, {orders}, {nation} WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND s_nationkey = n_nationkey AND p_type LIKE 'ECONOMY%' GROUP BY CAST(year(o_orderdate) AS INTEGER)",
    "q9": "SELECT n_name, CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum(l_extendedprice * (1 - l_discount) - p_retailprice * 0.1 * l_quantity), 2) AS profit FROM {part}, {supplier}, {lineitem}, {orders}, {nation} WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_type LIKE '%BRASS%' GROUP BY n_name, CAST(year(o_orderdate) AS INTEGER)",
    "q10": "SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM {customer}, {orders}, {lineitem}, {nation} WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20",
    "q11": "SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM {lineitem}, {supplier}, {nation} WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 2 GROUP BY l_partkey HAVING sum(l_extendedprice) > (SELECT sum(l_extendedprice) * 0.001 FROM {lineitem}, {supplier}, {nation} WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_regionkey = 2)",
    "q12": "SELECT l_linestatus, count(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 END) AS high_line, count(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 END) AS low_line FROM {orders}, {lineitem} WHERE o_orderkey = l_orderkey AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY l_linestatus",
    "q13": "SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM {customer} LEFT OUTER JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) c_orders GROUP BY c_count",
    "q14": "SELECT round(100 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo_revenue FROM {lineitem}, {part} WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1998-09-01' AND l_shipdate < DATE '1998-10-01'",
    "q15": "WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total_revenue FROM {lineitem} WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey) SELECT s_suppkey, s_name, total_revenue FROM {supplier} JOIN revenue ON s_suppkey = supplier_no WHERE total_revenue = (SELECT max(total_revenue) FROM revenue)",
    "q16": "SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM {lineitem}, {part} WHERE p_partkey = l_partkey AND p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND l_suppkey NOT IN (SELECT s_suppkey FROM {supplier} WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size",
    "q17": "SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM {lineitem} l, {part} p WHERE p.p_partkey = l.l_partkey AND p.p_brand = 'Brand#23' AND l.l_quantity < (SELECT 0.5 * avg(i.l_quantity) FROM {lineitem} i WHERE i.l_partkey = p.p_partkey)",
    "q18": "SELECT c_name, c_custkey, o_orderkey, o_totalprice, round(sum(l_quantity), 2) AS quantity FROM {customer}, {orders}, {lineitem} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem} GROUP BY l_orderkey HAVING sum(l_quantity) > 220) AND c_custkey = o_custkey AND o_orderkey = l_orderkey GROUP BY c_name, c_custkey, o_orderkey, o_totalprice",
    "q19": "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {lineitem} JOIN {part} ON p_partkey = l_partkey WHERE (p_brand = 'Brand#12' AND p_type LIKE 'STANDARD%' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30) OR (p_brand = 'Brand#34' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 50)",
    "q20": "SELECT s_name FROM {supplier}, {nation} WHERE s_suppkey IN (SELECT l_suppkey FROM {lineitem} WHERE l_partkey IN (SELECT p_partkey FROM {part} WHERE p_name LIKE '%1%') AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' GROUP BY l_suppkey HAVING sum(l_quantity) > 300) AND s_nationkey = n_nationkey AND n_regionkey < 3",
    "q21": "SELECT s_name, count(*) AS numwait FROM {supplier}, {lineitem} l1, {orders} WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_tax > 0.04 AND EXISTS (SELECT * FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey) AND NOT EXISTS (SELECT * FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_tax > 0.04) GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100",
    "q22": "SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS total FROM {customer} WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0) AND NOT EXISTS (SELECT * FROM {orders} WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY c_nationkey",
}


#: What another engine writes otherwise.
OTHER_SQL = {
    "o4_null_order": ("SELECT l_linenumber, nullif(l_tax, 0.0) AS t FROM {lineitem} ORDER BY t DESC, l_linenumber LIMIT 30", "SELECT l_linenumber, nullif(l_tax, 0.0) AS t FROM lineitem ORDER BY t DESC NULLS FIRST, l_linenumber LIMIT 30"),
    "f5_arrays": (
        "SELECT p_partkey, size(split(p_type, ' ')) AS parts, element_at(split(p_type, ' '), -1) AS last_part, array_contains(split(p_type, ' '), 'BRASS') AS brass, array_join(array_sort(split(p_type, ' ')), ',') AS sorted FROM {part}",
        "SELECT p_partkey, CAST(len(string_split(p_type, ' ')) AS INTEGER) AS parts, string_split(p_type, ' ')[-1] AS last_part, list_contains(string_split(p_type, ' '), 'BRASS') AS brass, array_to_string(list_sort(string_split(p_type, ' ')), ',') AS sorted FROM part",
    ),
    "f5_collect": (
        "SELECT o_orderstatus, array_join(array_sort(collect_set(o_orderpriority)), ';') AS all_priorities, size(map_from_arrays(collect_set(o_orderpriority), collect_set(o_orderpriority))) AS keys FROM {orders} GROUP BY o_orderstatus",
        "SELECT o_orderstatus, string_agg(DISTINCT o_orderpriority, ';' ORDER BY o_orderpriority) AS all_priorities, CAST(count(DISTINCT o_orderpriority) AS INTEGER) AS keys FROM orders GROUP BY o_orderstatus",
    ),
    "f5_explode": ("SELECT word, count(*) AS n FROM (SELECT explode(split(p_type, ' ')) AS word FROM {part}) x GROUP BY word", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS word FROM part) GROUP BY word"),
}


def run(spark: SparkSession, folder: str, text: str) -> DataFrame:
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(rewrite(text), **{n: table(spark, folder, n) for n in names})


_OWN = SQL | {name: own for name, (own, _) in OTHER_SQL.items()}
QUERIES = {name: (lambda spark, folder, text=text: run(spark, folder, text)) for name, text in _OWN.items()}
ORACLE_SQL = {name: re.sub(r"\{(\w+)\}", r"\1", text) for name, text in SQL.items()} | {name: other for name, (_, other) in OTHER_SQL.items()}
