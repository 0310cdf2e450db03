"""The 22 TPC-H shapes, adapted to the columns at hand. Supplier-part pairs of lineitem stand in for partsupp."""

from __future__ import annotations

from tallyforge.plans.registry import same

REVENUE = "l_extendedprice * (1 - l_discount)"

PRICING = f"""
SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base_price,
       round(sum({REVENUE}), 4) AS sum_disc_price, round(sum({REVENUE} * (1 + l_tax)), 4) AS sum_charge,
       avg(l_quantity) AS avg_qty, round(avg(l_extendedprice), 6) AS avg_price, round(avg(l_discount), 8) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= DATE '2001-09-02'
GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus
"""
same("tpch_q01", PRICING)

PAIRS = "SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey FROM lineitem"

same("tpch_q02", f"""
WITH partsupp AS ({PAIRS})
SELECT s_acctbal, s_name, n_name, p_partkey FROM part, supplier, partsupp, nation, region
WHERE p_partkey = ps_partkey AND s_suppkey = ps_suppkey AND p_size < 15 AND p_type = 'ECONOMY' AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
  AND s_acctbal = (SELECT max(s2.s_acctbal) FROM partsupp ps2, supplier s2, nation n2, region r2
                   WHERE p_partkey = ps2.ps_partkey AND s2.s_suppkey = ps2.ps_suppkey AND s2.s_nationkey = n2.n_nationkey
                     AND n2.n_regionkey = r2.r_regionkey AND r2.r_name = 'EUROPE')
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100
""")

same("tpch_q03", f"""
SELECT l_orderkey, round(sum({REVENUE}), 4) AS revenue, o_orderdate FROM customer, orders, lineitem
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10
""")

same("tpch_q04", """
SELECT o_orderpriority, count(*) AS order_count FROM orders
WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
  AND EXISTS (SELECT * FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)
GROUP BY o_orderpriority ORDER BY o_orderpriority
""")

same("tpch_q05", f"""
SELECT n_name, round(sum({REVENUE}), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey
  AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1997-01-01'
GROUP BY n_name ORDER BY revenue DESC
""")

same("tpch_q06", """
SELECT round(sum(l_extendedprice * l_discount), 4) AS revenue FROM lineitem
WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24
""")

same("tpch_q07", f"""
SELECT supp_nation, cust_nation, l_year, round(sum(volume), 4) AS revenue
FROM (SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(extract(YEAR FROM l_shipdate) AS BIGINT) AS l_year, {REVENUE} AS volume
      FROM supplier, lineitem, orders, customer, nation n1, nation n2
      WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
        AND ((n1.n_name = 'NATION_1' AND n2.n_name = 'NATION_2') OR (n1.n_name = 'NATION_2' AND n2.n_name = 'NATION_1'))
        AND l_shipdate BETWEEN DATE '1995-01-01' AND DATE '1998-12-31') AS shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year
""")

same("tpch_q08", f"""
SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 8) AS mkt_share
FROM (SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, {REVENUE} AS volume, n2.n_name AS nation
      FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
      WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
        AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey
        AND o_orderdate BETWEEN DATE '1995-01-01' AND DATE '1996-12-31' AND p_type = 'ECONOMY') AS all_nations
GROUP BY o_year ORDER BY o_year
""")

same("tpch_q09", f"""
SELECT nation, o_year, round(sum(amount), 4) AS sum_profit
FROM (SELECT n_name AS nation, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS o_year, {REVENUE} AS amount
      FROM part, supplier, lineitem, orders, nation
      WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%widget%') AS profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC
""")

same("tpch_q10", f"""
SELECT c_custkey, c_name, round(sum({REVENUE}), 4) AS revenue, c_acctbal, n_name FROM customer, orders, lineitem, nation
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01'
  AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20
""")

same("tpch_q11", """
WITH stock AS (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS qty FROM lineitem GROUP BY l_partkey, l_suppkey)
SELECT ps_partkey, sum(qty) AS total FROM stock, supplier, nation
WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7' GROUP BY ps_partkey
HAVING sum(qty) > (SELECT sum(qty) * 0.001 FROM stock, supplier, nation WHERE ps_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7')
ORDER BY total DESC, ps_partkey
""")

same("tpch_q12", """
SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
       CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM orders, lineitem WHERE o_orderkey = l_orderkey AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01'
GROUP BY l_linestatus ORDER BY l_linestatus
""")

same("tpch_q13", """
SELECT c_count, count(*) AS custdist
FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%' GROUP BY c_custkey) AS c_orders
GROUP BY c_count ORDER BY custdist DESC, c_count DESC
""")

same("tpch_q14", f"""
SELECT round(100.00 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE} ELSE 0 END) / sum({REVENUE}), 8) AS promo_revenue
FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-10-01'
""")

same("tpch_q15", f"""
WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum({REVENUE}), 4) AS total_revenue FROM lineitem
                 WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM supplier, revenue
WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey
""")

same("tpch_q16", f"""
WITH partsupp AS ({PAIRS})
SELECT p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM partsupp, part
WHERE p_partkey = ps_partkey AND p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (1, 4, 7, 9, 14, 19, 23, 36, 45, 49)
  AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size
""")

same("tpch_q17", """
SELECT round(sum(l_extendedprice) / 7.0, 4) AS avg_yearly FROM lineitem, part
WHERE p_partkey = l_partkey AND p_brand = 'Brand#3' AND l_quantity < (SELECT 0.5 * avg(l2.l_quantity) FROM lineitem l2 WHERE l2.l_partkey = p_partkey)
""")

same("tpch_q18", """
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS sum_qty FROM customer, orders, lineitem
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100
""")

same("tpch_q19", f"""
SELECT round(sum({REVENUE}), 4) AS revenue FROM lineitem, part
WHERE p_partkey = l_partkey AND ((p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5)
   OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10)
   OR (p_brand = 'Brand#14' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15))
""")

same("tpch_q20", f"""
WITH partsupp AS ({PAIRS})
SELECT s_name, s_suppkey FROM supplier, nation
WHERE s_suppkey IN (SELECT ps_suppkey FROM partsupp WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%widget%')
                      AND 20 < (SELECT sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey))
  AND s_nationkey = n_nationkey AND n_name = 'NATION_4' ORDER BY s_name
""")

same("tpch_q21", """
SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders, nation
WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
  AND EXISTS (SELECT * FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT * FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
  AND s_nationkey = n_nationkey AND n_name IN ('NATION_1', 'NATION_2', 'NATION_3')
GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100
""")

same("tpch_q22", """
SELECT c_mktsegment, count(*) AS numcust, round(sum(c_acctbal), 4) AS totacctbal FROM customer
WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
  AND NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-01-01')
GROUP BY c_mktsegment ORDER BY c_mktsegment
""")
