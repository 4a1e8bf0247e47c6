"""A messy partner roster derived from the customer table, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

AS_OF = "2024-06-30"

# p numbers a person, so that persons return under several partners. There are two loads: the second one lacks some
# members of the first, brings new ones, and changes names and ZIP codes. partner_9 has ended members alone.
ROSTER = """
SELECT concat('s', CAST(k AS STRING), CASE WHEN load_no = 2 THEN 'b' ELSE '' END) AS silver_record_id,
  concat('partner_', CASE WHEN p % 50 = 49 THEN '9' ELSE CAST(k % 5 AS STRING) END) AS partner_id,
  concat('m', CAST(k AS STRING)) AS partner_member_id,
  CASE WHEN p % 31 = 7 THEN NULL WHEN k % 3 = 0 THEN concat('  ', first, ' ') ELSE first END AS first_name,
  CASE WHEN p % 41 = 9 THEN '' WHEN load_no = 2 AND k % 10 = 0 THEN 'Newman' WHEN k % 4 = 1 THEN upper(last) ELSE last END AS last_name,
  CASE WHEN p % 29 = 3 THEN 'unknown' WHEN p % 53 = 5 THEN '2031-05-06'
    WHEN k % 6 = 0 THEN concat(y, '-', m, '-', d) WHEN k % 6 = 1 THEN concat(m, '/', d, '/', y) WHEN k % 6 = 2 THEN concat(m, '-', d, '-', y)
    WHEN k % 6 = 3 THEN concat(y, '/', m, '/', d) WHEN k % 6 = 4 THEN concat(y, m, d) ELSE concat(m, '/', d, '/', y) END AS dob,
  CASE WHEN p % 3 = 0 THEN 'male' WHEN p % 3 = 1 THEN 'F' WHEN p % 11 = 2 THEN 'nb' ELSE '?' END AS gender,
  CASE WHEN p % 13 = 4 THEN NULL ELSE concat(lpad(CAST(100 + p % 500 AS STRING), 3, '0'), '-', lpad(CAST(10 + p % 80 AS STRING), 2, '0'), '-', lpad(CAST(p * 7 % 10000 AS STRING), 4, '0')) END AS ssn,
  CASE WHEN p % 17 = 5 THEN NULL ELSE concat('user', CAST(p AS STRING), '@example.org') END AS email,
  CASE WHEN p % 2 = 0 THEN ' new york ' ELSE 'los angeles' END AS city,
  CASE WHEN p % 37 = 1 THEN '' WHEN p % 2 = 0 THEN 'n.y.' ELSE 'ca' END AS state,
  CASE WHEN p % 43 = 2 THEN 'none' WHEN load_no = 2 AND k % 6 = 0 THEN '60601' WHEN k % 5 = 2 THEN concat(CAST(501 + p % 400 AS STRING), '1') ELSE concat(CAST(10000 + p * 97 % 80000 AS STRING), CASE WHEN k % 7 = 3 THEN '-1234' ELSE '' END) END AS zip,
  concat(' plan', CAST(p % 4 AS STRING)) AS plan_code, concat(CAST(2015 + p % 8 AS STRING), '-0', CAST(1 + p % 9 AS STRING), '-15') AS start_date,
  CASE WHEN p % 50 = 49 THEN '2021-03-31' WHEN p % 5 = 0 THEN concat(CAST(2012 + p % 15 AS STRING), '-0', CAST(1 + k % 9 AS STRING), '-10') END AS end_date,
  make_timestamp(2024, 6, CAST(CASE WHEN load_no = 1 THEN 1 + k % 20 ELSE 21 + k % 9 END AS INT), CAST(k % 24 AS INT), 0, CAST(0 AS DOUBLE)) AS updated_at,
  CASE WHEN p % 19 = 1 THEN NULL ELSE concat('+1 (', CAST(200 + p % 700 AS STRING), ') 555-', lpad(CAST(p AS STRING), 4, '0')) END AS phone,
  concat(CAST(1 + p AS STRING), ' Main St ') AS address_line_1, CASE WHEN p % 3 = 1 THEN ' Acme  Corp' END AS employer_name,
  CASE WHEN p % 6 = 2 THEN ' Lee ' END AS middle_name, load_no, k, p
FROM (
  SELECT *, CAST(1930 + p * 7 % 75 AS STRING) AS y, lpad(CAST(1 + p % 12 AS STRING), 2, '0') AS m, lpad(CAST(13 + p * 3 % 15 AS STRING), 2, '0') AS d,
    CASE p % 8 WHEN 0 THEN 'Bob' WHEN 1 THEN 'Liz' WHEN 2 THEN 'José' WHEN 3 THEN 'Mary-Ann' WHEN 4 THEN 'Katherine' WHEN 5 THEN 'Jim Jr' WHEN 6 THEN 'Zoë' ELSE 'Priya' END AS first,
    concat(CASE p % 9 WHEN 0 THEN 'Ashcraft' WHEN 1 THEN 'O''Brien' WHEN 2 THEN 'Garcia-Lopez' WHEN 3 THEN 'Müller' WHEN 4 THEN 'van der Berg' WHEN 5 THEN 'Tymczak' WHEN 6 THEN 'Smith' WHEN 7 THEN 'Pfister' ELSE 'Honeyman' END,
      CASE WHEN p % 4 = 3 THEN ' III' ELSE '' END) AS last
  FROM (SELECT c_custkey AS k, c_custkey * 13 % 701 AS p, 1 AS load_no FROM customer WHERE c_custkey % 9 <> 8
    UNION ALL SELECT c_custkey AS k, c_custkey * 13 % 701 AS p, 2 AS load_no FROM customer WHERE c_custkey % 4 <> 3) x
) z
"""
