"""Built-in records: weaknesses and risks by public id, and templates that fill a source which can't be reached."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cinderfold.functions.text import clean_text, strip
from cinderfold.operators.corpus import first_wins
from cinderfold.sources.files import cyclic, write_document

#: Public weakness ids in order, with our own words on each. The ids are fixed values.
WEAKNESSES = [
    ("CWE-79", "Cross-site scripting", "A page is built from input that was not made safe for the place where it is shown, and a browser runs it as the site's own code."),
    ("CWE-787", "Out-of-bounds write", "Data is written before the start or behind the end of its buffer, which damages neighbouring memory and may hand over control."),
    ("CWE-89", "SQL injection", "Input becomes part of a database command and can change what the command means, so that data are read or altered at will."),
    ("CWE-416", "Use after free", "Memory is used through a pointer that was kept after the memory had been given back, and may by then hold something else."),
    ("CWE-78", "OS command injection", "A command for the operating system is put together from input, whose special characters let more commands run."),
    ("CWE-20", "Improper input validation", "What comes in is used without a check that it has the form, the range and the meaning which the code relies on."),
    ("CWE-125", "Out-of-bounds read", "Data are read from outside of the buffer they were meant to come from, which reveals memory or ends the program."),
    ("CWE-22", "Path traversal", "A file name from outside leads out of the folder that it should stay in, by parent folders or absolute paths in it."),
    ("CWE-352", "Cross-site request forgery", "A server can't tell a request that its user meant to send from one that another site made the user's browser send."),
    ("CWE-434", "Unrestricted upload", "Files of dangerous kinds are taken in and later run or served, as nobody limits what may be uploaded and where it goes."),
    ("CWE-862", "Missing authorization", "An action or a resource is reached without any check of whether the one who asks for it is allowed to have it."),
    ("CWE-476", "NULL pointer dereference", "A pointer that is expected to lead somewhere is null when it is followed, which mostly ends the program at once."),
    ("CWE-190", "Integer overflow", "A calculation gives a number that its type can't hold; the wrapped result is then used as a size, an index or a bound."),
    ("CWE-502", "Deserialization of untrusted data", "Objects are restored from bytes that anybody may have written, and restoring them already runs code of their choice."),
    ("CWE-287", "Improper authentication", "Somebody claims to be a certain user and the claim isn't proved well enough before it is believed and acted upon."),
]
#: Public risk ids in order, with our own words on each. The ids and names are fixed values.
RISKS = [
    ("A01:2021", "Broken Access Control", "Users get to see and do what their rights don't cover, by other ids in addresses, missing checks or raised roles."),
    ("A02:2021", "Cryptographic Failures", "Data that need protection are sent or kept in the clear, or under ciphers, keys and modes that are known to be weak."),
    ("A03:2021", "Injection", "Input is read as part of a query, command or page by an interpreter that can't tell the program from its data."),
    ("A04:2021", "Insecure Design", "The controls that would stop an attack were never planned, so that no correct implementation could have them."),
    ("A05:2021", "Security Misconfiguration", "Default accounts, open storage, needless features or talkative errors are left as they came on some layer."),
    ("A06:2021", "Vulnerable and Outdated Components", "Parts with known flaws, or without support, run with the rights of the application that includes them."),
    ("A07:2021", "Identification and Authentication Failures", "Guessing of passwords isn't slowed, sessions don't end, or a second factor is missing or easily avoided."),
    ("A08:2021", "Software and Data Integrity Failures", "Updates, packages or build steps are trusted without a proof of where they come from and that they are whole."),
    ("A09:2021", "Security Logging and Monitoring Failures", "Attacks leave no record, or nobody reads the records, so that breaches go on for months before they are seen."),
    ("A10:2021", "Server-Side Request Forgery (SSRF)", "A server fetches an address that its user chose, and so reaches hosts that only the server was meant to reach."),
]


def _records(spark: SparkSession, rows: list[tuple[str, str, str]], head: str, source: str, quota: int, least: int) -> DataFrame:
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, id string, name string, words string")
    text = clean_text(F.concat(F.lit(head), F.col("id"), F.lit(": "), F.col("name"), F.lit("\n\n"), F.col("words")))
    df = df.select("ord", "id", text.alias("text"), F.lit(source).alias("source")).where(F.length("text") >= least)
    return cyclic(df, "ord", quota, len(rows)).select("id", "text", "source", "copy")


def weaknesses(spark: SparkSession, quota: int = 5000, least: int = 100) -> DataFrame:
    """id, text, source, copy: the weaknesses in turn up to the quota."""
    return _records(spark, WEAKNESSES, "", "cwe", quota, least)


def risks(spark: SparkSession, quota: int = 2000, least: int = 100) -> DataFrame:
    """id, text, source, copy: the risks in turn up to the quota."""
    return _records(spark, RISKS, "OWASP ", "owasp", quota, least)


def from_templates(spark: SparkSession, templates: list[str], n: int, prefix: str, source: str) -> DataFrame:
    """n records that take the templates in turn; {n} in a template is the record's number."""
    texts = F.array(*map(F.lit, templates))
    row = spark.range(n).withColumn("t", F.get(texts, (F.col("id") % len(templates)).cast("int")))
    return row.select(F.concat(F.lit(prefix), F.col("id")).alias("id"), F.replace(F.col("t"), F.lit("{n}"), F.col("id").cast("string")).alias("text"), F.lit(source).alias("source"))


#: Topics of challenge texts, with two facts on each; templates of techniques and patterns. Our own words.
TOPICS = {
    "web": ("a form that trusts its hidden fields", "a session cookie that can be guessed"),
    "binary": ("a buffer shorter than what is read into it", "a format string that the user writes"),
    "crypto": ("a modulus whose factors lie close together", "a key stream that is used twice"),
    "reversing": ("a check that compares one letter at a time", "a loop that unpacks the rest of the program"),
    "forensics": ("a picture with bytes behind its end", "a deleted file that the disk still holds"),
    "network": ("a capture in which names carry the data", "a service that answers before it asks who calls"),
    "cloud": ("a bucket that anybody may list", "a token with more rights than its task"),
    "mobile": ("a store whose key lies beside it", "a link handler that opens any address"),
    "hardware": ("a debug port that was left open", "a power trace that shows each bit of the key"),
    "misc": ("a puzzle hidden in white space", "a jail whose rules forget one function"),
}
TECHNIQUES = [f"Record {{n}} of the technique {name}: {what}." for name, what in (("discovery", "the intruder lists what the host can reach before any other step"), ("persistence", "a start-up entry brings the program back after each restart"), ("evasion", "the program hides among processes that nobody looks at"), ("collection", "files of interest are gathered in one folder to be taken away"), ("exfiltration", "data leave in small pieces among ordinary requests"), ("escalation", "a service that runs with more rights is made to run a command"), ("movement", "stolen credentials open the next host in the network"), ("impact", "data are made unusable so that their owner has to pay"))]
PATTERNS = [f"Record {{n}} of the attack pattern {name}: {what}." for name, what in (("flooding", "more requests come than the service can answer"), ("spoofing", "a message claims a sender that it doesn't have"), ("probing", "odd input is sent to learn from the errors that come back"), ("tampering", "a value is changed between its check and its use"), ("guessing", "many secrets are tried until one of them opens the door"))]


def challenge_texts() -> list[str]:
    """21 texts on the topics: two on each and one on them all."""
    own = [f"A challenge on {topic}: it starts from {fact}, and the flag is found by following that to its end." for topic, facts in TOPICS.items() for fact in facts]
    return [*own, f"A challenge on {', '.join(TOPICS)}: every step gives the key to the next one."]


def fallback(spark: SparkSession, source: str) -> DataFrame:
    """id, text, source of the records that stand in for a source that can't be reached: 200 techniques (8 templates in
    turn), 200 attack patterns (5), or the 21 challenge texts, each once, in an order that hangs on the seed 42."""
    if source == "ctf":
        texts = challenge_texts()
        return seeded_order(unique_texts(from_templates(spark, texts, len(texts), "ctf-", source)), "id")
    return from_templates(spark, {"mitre_attack": TECHNIQUES, "capec": PATTERNS}[source], 200, f"{source}-", source)


def unique_texts(records: DataFrame, order: str = "id") -> DataFrame:
    """The first record of each text, case and outer white space aside."""
    return first_wins(records.withColumn("_h", F.md5(F.lower(strip(F.coalesce("text", F.lit("")))).cast("binary"))), ["_h"], [order]).drop("_h")


def generated(prompts: DataFrame, transport: Callable[[str], str], attempts: int = 3, wait: float = 5.0) -> DataFrame:
    """prompts (id, prompt) with text from any transport, `wait` seconds between attempts; a prompt that fails every one
    has null text and its error."""

    def run(frames: Iterator) -> Iterator:
        for frame in frames:
            texts, errors = [], []
            for prompt in frame["prompt"]:
                text, error = None, None
                for i in range(attempts):
                    if i:
                        time.sleep(wait)
                    try:
                        text, error = transport(prompt), None
                        break
                    except Exception as e:  # kept in the row, so that no failure is lost
                        error = str(e)
                texts.append(text)
                errors.append(error)
            yield frame.assign(text=texts, error=errors)

    return prompts.select("id", "prompt").mapInPandas(run, "id string, prompt string, text string, error string")


def seeded_order(df: DataFrame, ident: str, seed: int = 42) -> DataFrame:
    """df in an order that hangs on the id and the seed alone."""
    return df.orderBy(F.xxhash64(F.col(ident), F.lit(seed)), ident)


def required(df: DataFrame, *keys: str) -> DataFrame:
    """df, unless a row lacks one of the keys."""
    missing = df.where(" or ".join(f"`{k}` is null or `{k}` = ''" for k in keys)).limit(1).count()
    if missing:
        raise ValueError(f"a row lacks one of {', '.join(keys)}")
    return df


def export(spark: SparkSession, path: str, facts: dict[str, str]) -> DataFrame:
    """Write what describes the files below a path (facts and their SHA-256) beside them as a document; returns checksums()."""
    sums = checksums(spark, path)
    listed = sums.agg(F.to_json(F.sort_array(F.collect_list(F.struct("file", "bytes", "sha256")))).alias("files"))  # one row a file of one export
    write_document(listed.select(*[F.lit(v).alias(k) for k, v in facts.items()], "files"), f"{path.rstrip('/')}.export.json")
    return sums


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """file, bytes and sha256 of every file below a path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
