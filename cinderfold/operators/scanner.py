"""Rule scan of source code, line by line."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cinderfold.functions.text import bind

#: category, severity, pattern (case ignored). Fixed values.
RULES = [
    ("SQL Injection", "CRITICAL", r"""(\bexec\b|\bexecute\b).*\+.*\b(req|request|params|query|input|user)\b"""),
    ("SQL Injection", "CRITICAL", r"""f["'].*SELECT.*\{.*\}"""),
    ("SQL Injection", "CRITICAL", r"""\.format\(.*\).*(?:SELECT|INSERT|UPDATE|DELETE|DROP)"""),
    ("SQL Injection", "CRITICAL", r"""query\s*\(\s*[`"'].*\$\{"""),
    ("Cross-Site Scripting (XSS)", "HIGH", r"""innerHTML\s*=\s*(?!['"]<)"""),
    ("Cross-Site Scripting (XSS)", "HIGH", r"""document\.write\s*\("""),
    ("Cross-Site Scripting (XSS)", "MEDIUM", r"""dangerouslySetInnerHTML"""),
    ("Cross-Site Scripting (XSS)", "HIGH", r"""\.html\(\s*(?:req|request|params|query|input|user)"""),
    ("Command Injection", "CRITICAL", r"""(?:exec|spawn|system|popen)\s*\(.*\+.*(?:req|request|params|input|user)"""),
    ("Command Injection", "CRITICAL", r"""child_process.*exec\s*\(\s*`"""),
    ("Command Injection", "CRITICAL", r"""os\.system\s*\(.*(?:input|argv|request)"""),
    ("Command Injection", "HIGH", r"""subprocess\.(?:call|run|Popen)\s*\(.*shell\s*=\s*True"""),
    ("Hardcoded Secrets", "HIGH", r"""(?:password|passwd|secret|api_key|apikey|token|auth)\s*=\s*["'][^"']{8,}"""),
    ("Hardcoded Secrets", "CRITICAL", r"""(?:AWS_SECRET|PRIVATE_KEY|-----BEGIN (?:RSA|EC|DSA|OPENSSH) PRIVATE KEY)"""),
    ("Insecure Configuration", "HIGH", r"""(?:verify|ssl|tls)\s*=\s*False"""),
    ("Insecure Configuration", "MEDIUM", r"""CORS\s*\(\s*\*\s*\)|Access-Control-Allow-Origin.*\*"""),
    ("Insecure Configuration", "MEDIUM", r"""DEBUG\s*=\s*True"""),
    ("Path Traversal", "HIGH", r"""(?:readFile|readFileSync|open|fopen)\s*\(.*(?:req|request|params|query|input|user)"""),
    ("Path Traversal", "MEDIUM", r"""\.\./|\.\.\\|\.\.%2[fF]"""),
]
#: One of these, in lower case, is in every line that a rule of RULES matches, in order.
NEEDS = [
    ("exec",),
    ("select",),
    (".format(",),
    ("${",),
    ("innerhtml",),
    ("document.write",),
    ("innerhtml",),
    (".html(",),
    ("exec", "spawn", "system", "popen"),
    ("child_process",),
    ("os.system",),
    ("subprocess.",),
    ("password", "passwd", "secret", "api_key", "apikey", "token", "auth"),
    ("aws_secret", "private_key", "-----begin "),
    ("false",),
    ("cors", "access-control-allow-origin"),
    ("debug",),
    ("readfile", "open"),
    ("../", "..\\", "..%2f"),
]
#: What to say of each rule, in the order of RULES.
MESSAGES = [
    "A query is put together from request data; bind parameters instead",
    "A query in an f-string takes whatever its values hold; bind parameters instead",
    "A query is filled in by format(); bind parameters instead",
    "A query in a template literal takes whatever its values hold; prepare the statement",
    "innerHTML is set from a value; set textContent, or clean the value",
    "document.write runs what it writes; build nodes instead",
    "dangerouslySetInnerHTML is used; its value has to be cleaned first",
    "Request data go into .html(); clean them first",
    "A command line is put together from request data; pass a list of arguments",
    "A shell runs a template literal; use execFile with a list of arguments",
    "os.system runs what came from outside; use subprocess without a shell",
    "subprocess goes through a shell; leave shell=True out",
    "A secret stands in the code; read it from the environment",
    "A private key or cloud secret stands in the code; take it out and replace it",
    "Certificates aren't checked; leave verification on",
    "Any origin is let in; name those that may",
    "Debug mode is on; turn it off in production",
    "A file name comes from request data; check that it stays in its folder",
    "A path leads to a parent folder; check what it is made from",
]
LEVELS = {"CRITICAL": "Error", "HIGH": "Warning"}


def code_lines(files: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """ident, line (from 1), code: lines that aren't comments and that some rule may match."""
    lines = files.where(_may_match(F.col(text))).select(ident, F.posexplode(F.split(F.col(text), "\n")).alias("_i", "code"))
    return lines.where(_may_match(F.col("code")) & ~F.regexp_like("code", F.lit(r"^\s*(//|#|\*)"))).select(ident, (F.col("_i") + 1).alias("line"), "code")


def _may_match(code: Column) -> Column:
    """A plain search for what the rules need, which is much cheaper than the rules; null for null."""
    literals = sorted({x for own in NEEDS for x in own})
    return bind(F.lower(code), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in literals]))


def rule_counts(files: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """ident, rule_id, category, severity, n_hits: matches of every rule, all in one pass over the lines."""
    lines = code_lines(files, ident, text)
    hits = F.array(*[F.struct(F.lit(i).alias("rule_id"), F.lit(c).alias("category"), F.lit(s).alias("severity"), F.regexp_count("code", F.lit(f"(?i){p}")).alias("n")) for i, (c, s, p) in enumerate(RULES)])
    some = lines.select(ident, F.explode(F.filter(hits, lambda h: h["n"] > 0)).alias("h"))
    return some.groupBy(ident, "h.rule_id", "h.category", "h.severity").agg(F.sum("h.n").alias("n_hits"))


def findings(files: DataFrame, ident: str, text: str = "text") -> DataFrame:
    """ident, rule_id, line, column, category, severity, description, code: every match with its place.

    Lines without any match are dropped by built-in expressions; only the others go to Python for places.
    """
    any_rule = "(?i)" + "|".join(f"(?:{p})" for _, _, p in RULES)
    lines = code_lines(files, ident, text).where(F.regexp_like("code", F.lit(any_rule)))
    kind = dict(lines.dtypes)[ident]

    def run(frames: Iterator) -> Iterator:
        import pandas as pd

        rules = [re.compile(p, re.IGNORECASE) for _, _, p in RULES]
        for frame in frames:
            rows = [(i, n, line, m.start() + 1, RULES[n][0], RULES[n][1], MESSAGES[n], code.strip()) for i, line, code in frame.itertuples(index=False) for n, r in enumerate(rules) for m in r.finditer(code)]
            yield pd.DataFrame(rows, columns=[ident, "rule_id", "line", "column", "category", "severity", "description", "code"])

    return lines.mapInPandas(run, f"{ident} {kind}, rule_id int, line int, column int, category string, severity string, description string, code string")


def level(severity: Column) -> Column:
    """Diagnostic level of a severity."""
    out = F.lit("Information")
    for s, name in LEVELS.items():
        out = F.when(severity == s, name).otherwise(out)
    return out
