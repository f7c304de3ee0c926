"""The relational core as named queries: Spark SQL over the tables, and the same in DuckDB's dialect where it differs."""

from __future__ import annotations

#: name -> SQL that both engines take
BOTH: dict[str, str] = {
    "scan_limit_ordered": "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders ORDER BY o_orderkey LIMIT 50",
    "values_rows": "SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(id, name)",
    "select_no_from": "SELECT 1 + 2 AS three, 'x' AS x",
    "filter_eq": "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    "filter_range": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-03-01 00:00:00' AND l_shipdate < TIMESTAMP '1996-03-08 00:00:00'",
    "between": "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 12",
    "in_list": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey IN (1, 3)",
    "not_in": "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey NOT IN (1, 3)",
    "like_ci": "SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%' OR p_name ILIKE '_a%'",
    "is_null": "SELECT count(*) AS n FROM orders WHERE o_orderpriority IS NULL OR o_custkey IS NOT NULL",
    "and_or_not": "SELECT s_suppkey FROM supplier WHERE (s_acctbal > 5000 OR s_nationkey = 3) AND NOT s_nationkey = 7",
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS code FROM orders",
    "arithmetic": "SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, -l_quantity AS minus_qty, CAST(l_partkey % 7 AS BIGINT) AS rem FROM lineitem",
    "join_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey",
    "join_left_count": "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey",
    "join_right": "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 8000",
    "join_full": "SELECT a.c_custkey AS a_key, b.s_suppkey AS b_key FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0) a FULL OUTER JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) b ON a.c_custkey = b.s_suppkey",
    "join_cross_small": "SELECT r_name, n_name FROM region CROSS JOIN nation",
    "join_theta": "SELECT a.n_nationkey AS a_key, b.n_nationkey AS b_key FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_comma_multi": "SELECT n_name, count(*) AS n FROM customer, orders, nation WHERE c_custkey = o_custkey AND c_nationkey = n_nationkey AND o_totalprice > 50000 GROUP BY n_name",
    "join_using": "SELECT k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation) a JOIN (SELECT s_nationkey AS k, s_name AS y FROM supplier) b USING (k)",
    "join_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 150000)",
    "join_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "group_count": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "group_multi_agg": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS price, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "group_expr": "SELECT year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY year(o_orderdate)",
    "agg_global": "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean FROM orders",
    "agg_empty": "SELECT count(*) AS n, sum(o_custkey) AS s FROM orders WHERE o_orderkey < 0",
    "count_distinct": "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type",
    "agg_arith": "SELECT round(100.0 * sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey",
    "round_avg": "SELECT event_type, round(avg(value), 3) AS mean FROM events GROUP BY event_type",
    "min_max_string": "SELECT n_regionkey, min(n_name) AS lo, max(n_name) AS hi FROM nation GROUP BY n_regionkey",
    "having_alias": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12",
    "having_agg": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND sum(o_totalprice) > 0",
    "distinct_multi": "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem",
    "any_value_group": "SELECT n_regionkey, count(*) AS n, any_value(n_name) IS NOT NULL AS some FROM nation GROUP BY n_regionkey",
    "star_of_table": "SELECT n.* FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name <> 'nowhere'",
    "bit_operations": "SELECT o_orderkey, o_orderkey & 255 AS low, o_orderkey | 7 AS up, o_orderkey % 13 AS rem FROM orders",
    "null_safe_equal": "SELECT count(*) AS n FROM nation a JOIN nation b ON nullif(a.n_regionkey, 1) IS NOT DISTINCT FROM nullif(b.n_regionkey, 1)",
    "concat_operator": "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS STRING) AS tag FROM nation",
    "rollup": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "filter_clause": "SELECT count(*) FILTER (WHERE event_type = 'view') AS views, count(*) FILTER (WHERE event_type = 'purchase') AS purchases FROM events",
    "row_number": "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events",
    "rank_dense": "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part",
    "lag_lead": "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after_type FROM events",
    "running_sum": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS total FROM events",
    "moving_avg": "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS mean FROM events",
    "ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS q FROM customer",
    "order_multi": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice, o_orderkey LIMIT 40",
    "order_ordinal": "SELECT s_nationkey, s_suppkey FROM supplier ORDER BY 1, 2 LIMIT 25",
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 15",
    "nulls_order": "SELECT k FROM (SELECT CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey END AS k FROM nation) t ORDER BY k NULLS LAST LIMIT 22",
    "union_all": "SELECT n_regionkey AS k FROM nation UNION ALL SELECT r_regionkey FROM region",
    "union_distinct": "SELECT n_regionkey AS k FROM nation UNION SELECT r_regionkey FROM region",
    "intersect_rows": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "except_rows": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.8 FROM orders)",
    "in_subquery": "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "correlated_subquery": "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer",
    "cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS t FROM orders GROUP BY o_custkey) SELECT c_mktsegment, count(*) AS n FROM big JOIN customer ON c_custkey = o_custkey WHERE t > 500000 GROUP BY c_mktsegment",
    "cte_recursive": "WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 20) SELECT i FROM n",
    "from_subquery": "SELECT status, max(n) AS most FROM (SELECT o_orderstatus AS status, o_custkey, count(*) AS n FROM orders GROUP BY o_orderstatus, o_custkey) t GROUP BY status",
    "upper_lower": "SELECT DISTINCT upper(c_mktsegment) AS up, lower(c_mktsegment) AS low FROM customer",
    "coalesce_if": "SELECT n_nationkey, coalesce(CASE WHEN n_regionkey = 1 THEN NULL ELSE n_name END, 'none') AS name FROM nation",
    "round_half": "SELECT p_partkey, round(p_retailprice, 1) AS r1, CAST(round(p_retailprice) AS BIGINT) AS r0 FROM part",
    "tpch_q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS sum_disc, CAST(sum(CAST(l_extendedprice * (1 - l_discount) * (1 + l_tax) AS DECIMAL(18,6))) AS DOUBLE) AS sum_charge, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "tpch_q3": "SELECT l_orderkey, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15 00:00:00' AND l_shipdate > TIMESTAMP '1998-03-15 00:00:00' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, l_orderkey LIMIT 10",
    "tpch_q5": "SELECT n_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00' AND o_orderdate < TIMESTAMP '1998-01-01 00:00:00' GROUP BY n_name",
    "tpch_q6": "SELECT CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18,4))) AS DOUBLE) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-01-01 00:00:00' AND l_discount BETWEEN 0.045 AND 0.075 AND l_quantity < 24",
    "tpch_q10": "SELECT c_custkey, c_name, CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DOUBLE) AS revenue, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= TIMESTAMP '1996-10-01 00:00:00' AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC, c_custkey LIMIT 20",
    "tpch_q14": "SELECT round(100.0 * sum(CASE WHEN p_type = 'PROMO' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_shipdate >= TIMESTAMP '1997-09-01 00:00:00' AND l_shipdate < TIMESTAMP '1997-10-01 00:00:00'",
}

#: name -> (Spark SQL, DuckDB SQL)
EACH: dict[str, tuple[str, str]] = {
    "xor_bits": ("SELECT o_orderkey, o_orderkey ^ 5 AS x FROM orders", "SELECT o_orderkey, xor(o_orderkey, 5) AS x FROM orders"),
    "if_function": ("SELECT n_nationkey, if(n_regionkey = 1, 'one', n_name) AS name FROM nation", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'one' ELSE n_name END AS name FROM nation"),
    "maths": ("SELECT p_partkey, floor(p_retailprice) AS lo, ceil(p_retailprice) AS hi, abs(-p_size) AS a, power(p_size, 2) AS sq, round(sqrt(p_size), 6) AS root, greatest(p_size, 10) AS g FROM part", "SELECT p_partkey, floor(p_retailprice)::BIGINT AS lo, ceil(p_retailprice)::BIGINT AS hi, abs(-p_size) AS a, power(p_size, 2) AS sq, round(sqrt(p_size), 6) AS root, greatest(p_size, 10) AS g FROM part"),
    "safe_div": ("SELECT n_nationkey, round(try_divide(100, n_regionkey), 6) AS q FROM nation", "SELECT n_nationkey, round(100 / nullif(n_regionkey, 0), 6) AS q FROM nation"),
    "length_bytes_chars": ("SELECT DISTINCT c_mktsegment, octet_length(c_mktsegment) AS b, char_length(concat(c_mktsegment, 'é')) AS c FROM customer", "SELECT DISTINCT c_mktsegment, strlen(c_mktsegment)::INTEGER AS b, length(concat(c_mktsegment, 'é'))::INTEGER AS c FROM customer"),
    "concat_null": ("SELECT n_nationkey, concat_ws('', n_name, CASE WHEN n_regionkey = 1 THEN NULL ELSE '!' END) AS s FROM nation", "SELECT n_nationkey, concat(n_name, CASE WHEN n_regionkey = 1 THEN NULL ELSE '!' END) AS s FROM nation"),
    "date_format": ("SELECT o_orderkey, date_format(o_orderdate, 'yyyy-MM') AS ym FROM orders", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS ym FROM orders"),
    "date_add_diff": ("SELECT o_orderkey, CAST(date_add(CAST(o_orderdate AS DATE), 30) AS STRING) AS due, CAST(datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS age FROM orders", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS due, date_diff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01') AS age FROM orders"),
    "timestampdiff_lag": ("SELECT event_id, CAST(timestampdiff(SECOND, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) AS BIGINT) AS gap FROM events", "SELECT event_id, CAST(floor(epoch_us(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) / 1000000) AS BIGINT) AS gap FROM events"),
    "json_extract": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
    "substring_regexp": ("SELECT p_partkey, substring(p_name, 1, 3) AS head FROM part WHERE p_name RLIKE '^[A-Pa-m].*[0-9]'", "SELECT p_partkey, substring(p_name, 1, 3) AS head FROM part WHERE regexp_matches(p_name, '^[A-Pa-m].*[0-9]')"),
    "intersect_all": ("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    "except_all": ("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "natural_join": ("SELECT * FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) NATURAL JOIN region", "SELECT * FROM (SELECT n_regionkey AS r_regionkey, n_name FROM nation) a NATURAL JOIN region"),
    # Spark numbers the rows in no order where LIMIT's ORDER BY holds a column that the same SELECT leaves out, so an inner SELECT keeps it; the hint deals a large file out before it is sorted
    "lateral_latest": ("SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice FROM (SELECT /*+ REPARTITION(o_orderkey) */ o_orderkey, o_custkey, o_totalprice FROM orders) WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey NULLS LAST LIMIT 1)) t", "SELECT c_custkey, t.o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) t"),
}
