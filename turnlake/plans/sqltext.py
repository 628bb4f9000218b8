"""SQL spellings of the scalar formats, shared by the checks."""

from __future__ import annotations


def ts(ms: str, sep: str = ".") -> str:
    return (
        f"printf('%02d:%02d:%02d{sep}%03d', ({ms})//3600000, (({ms})//60000)%60, (({ms})//1000)%60, ({ms})%1000)"
    )


def half_even(x: str, digits: int) -> str:
    """x * 10^digits, half-even on the exact binary value (product error by splitting)."""
    x, m = f"({x})::DOUBLE", f"{10**digits}::DOUBLE"
    high = f"({x}*134217729::DOUBLE-({x}*134217729::DOUBLE-{x}))"
    err = f"(({high}*{m}-{x}*{m})+({x}-{high})*{m})"
    half = f"({x}*{m}-floor({x}*{m}))"
    odd = f"(floor({x}*{m})::BIGINT%2<>0)"
    up = f"({half}>0.5 OR ({half}=0.5 AND ({err}>0 OR ({err}=0 AND {odd}))))"
    return f"(floor({x}*{m})::BIGINT+CASE WHEN {up} THEN 1 ELSE 0 END)"


def rnd(x: str, digits: int) -> str:
    return f"({half_even(x, digits)}/{10**digits}::DOUBLE)"


def fixed2(x: str) -> str:
    v = half_even(x, 2)
    return f"({v}//100)::VARCHAR||'.'||lpad(({v}%100)::VARCHAR,2,'0')"


def ms2(ms: str) -> str:
    return fixed2(f"({ms})/1000")


def ms3(ms: str) -> str:
    return f"(({ms})//1000)::VARCHAR||'.'||lpad((({ms})%1000)::VARCHAR,3,'0')"


def norm_words(x: str) -> str:
    return (
        rf"list_filter(regexp_split_to_array(regexp_replace(lower({x}),'[^\p{{L}}\p{{N}}_\t-\r\x1c-\x20\x{{85}}\p{{Z}}]','','g'),"
        r"'[\t-\r\x1c-\x20\x{85}\p{Z}]+'), lambda x: x<>'')"
    )


def simple_words(x: str) -> str:
    return rf"list_filter(regexp_split_to_array(lower({x}),'[\t-\r\x1c-\x20\x{{85}}\p{{Z}}]+'), lambda x: x<>'')"


def edit_ctes(pairs: str) -> str:
    """CTE ``counts(k, s, i, d, n)`` from ``pairs`` (k, ref list, hyp list): row-by-row matrix.

    The left neighbour is resolved by a running minimum, its path by the last
    defined value; equal costs prefer match, substitution, deletion, insertion.
    """
    return f"""
 pairs AS MATERIALIZED (SELECT row_number() OVER ()::INT AS id, * FROM ({pairs})),
 rt AS MATERIALIZED (SELECT id, hash(unnest(ref)) AS r, unnest(range(1, len(ref)+1))::INT AS i FROM pairs),
 dp AS (
  SELECT id, 0 AS i, j, CASE WHEN j>0 THEN hash(hyp[j]) END AS h, j AS c, 0 AS d FROM (SELECT id, hyp, unnest(range(0, len(hyp)+1))::INT AS j FROM pairs)
  UNION ALL
  SELECT id, i, j, h, c, last_value(path IGNORE NULLS) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING)::INT AS d FROM (
   SELECT id, i, j, h, c, CASE WHEN j=0 THEN i WHEN same OR c=gc+1 THEN gd WHEN c=uc+1 THEN ud+1 END AS path FROM (
    SELECT *, (min(x-j) OVER (PARTITION BY id ORDER BY j ROWS UNBOUNDED PRECEDING)+j)::INT AS c FROM (
     SELECT id, i, j, h, uc, ud, gc, gd, same, CASE WHEN j=0 THEN i WHEN same THEN gc ELSE least(gc,uc)+1 END AS x FROM (
      SELECT dp.id, rt.i, j, h, c AS uc, d AS ud, lag(c) OVER w AS gc, lag(d) OVER w AS gd, coalesce(r=h, false) AS same
      FROM dp JOIN rt ON dp.id=rt.id AND rt.i=dp.i+1 WINDOW w AS (PARTITION BY dp.id ORDER BY j)))))
 ),
 counts AS (
  SELECT k, (c-(d+len(hyp)-len(ref))-d)::BIGINT AS substitutions, (d+len(hyp)-len(ref))::BIGINT AS insertions, d::BIGINT AS deletions,
   len(ref)::BIGINT AS num_words, c::BIGINT AS num_errors FROM dp JOIN pairs ON pairs.id=dp.id AND i=len(ref) AND j=len(hyp)
 )"""
