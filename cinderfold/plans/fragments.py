"""DuckDB expressions that several oracles share."""

from __future__ import annotations

from cinderfold.functions import text

W, NW = text.SPACE_RE2, text.NOT_SPACE_RE2
NORM = rf"regexp_replace(lower(regexp_replace(coalesce(text, ''), '\A{W}+|{W}+\z', '', 'g')), '{W}+', ' ', 'g')"
CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(coalesce({0}, '')), '[^\n\t\x20-\x7e]', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '(?m)^[ \t]+|[ \t]+$', '', 'g'), ' {{2,}}', ' ', 'g'), '\A[ \t\n]+|[ \t\n]+\z', '', 'g')"""
WORDS = rf"regexp_extract_all(lower(coalesce(text, '')), '{NW}+')"
ALPHA = r"list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'), lambda x: lower(x))"
TOKENS = f"list_transform({WORDS}, lambda x: CAST(length(x) AS INTEGER))"
SPLIT = f"""hashed AS (SELECT *, md5({NORM}) AS norm_md5 FROM documents),
 firsts AS (SELECT * FROM hashed QUALIFY row_number() OVER (PARTITION BY norm_md5 ORDER BY doc_id) = 1),
 bucketed AS (SELECT *, CAST(('0x' || norm_md5)::UHUGEINT % 100 AS INTEGER) AS bucket FROM firsts),
 parts AS (SELECT *, CASE WHEN bucket < 5 THEN 'val' ELSE 'train' END AS split FROM bucketed)"""
