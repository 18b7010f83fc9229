"""Column functions on labels, paths and texts; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CODE = sorted("c cc cpp cs cxx go h hpp java js kt kts php py rb rs scala swift ts tsx".split())
DOCUMENT, PAPER, IMAGE = ["md", "rst", "txt"], ["pdf"], sorted("gif jpeg jpg png svg webp".split())
SKIPPED_DIRS = sorted({".git", "lib64", "node_modules", "out", "site-packages", "target"} | {"build", "dist"} | {d + e for d in ("", ".") for e in ("venv", "env")} | {f".{t}_cache" for t in ("mypy", "pytest", "ruff")} | {"__pycache__", ".eggs", ".tox"})
NOISE_SUFFIX = r"(?:_v?env|\.egg-info)$"
#: (pattern, ignore case): file names and paths that may hold secrets.
SENSITIVE = [
    (r"(?:^|[/\\])\.env(?:rc)?(?:\.|$)", True),
    (r"\.(?:p12|p8|pem|pfx|crt|cert|der|key)$", True),
    (r"token|secret|passw(?:or)?d|private_key|credential", True),
    (r"id_(?:ed25519|ecdsa|[dr]sa)(?:\.pub)?$", False),
    (r"\.(?:htpasswd|netrc|pgpass)$", True),
    (r"service.account|(?:gcloud|aws)_credentials", True),
]
#: (pattern, ignore case): marks of a scientific paper; three of them make one.
PAPER_MARKS = [(rf"\b{w}\b", True) for w in ("abstract", "arxiv", "journal", "literature", "preprint", "proceedings", "we propose")] + [
    (r"\bdoi\s*:", True),
    (r"\\cite[{]", False),
    (r"\[[0-9]+\]", False),
    (r"\[\n[0-9]+\n\]", False),
    (r"equation\s+[0-9]|eq\.\s*[0-9]", True),
    (r"[0-9]{4}\.[0-9]{4}", False),
]


def _rx(pattern: str, ignore_case: bool) -> str:
    return ("(?i)" if ignore_case else "") + pattern


def strip_chars(c: Column, chars: str) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^[{chars}]+", ""), f"[{chars}]+$", "")


def make_id(*parts: Column) -> Column:
    """Identifier from name parts: outer `_` and `.` go, empty parts go, other than ASCII letters and digits become `_`."""
    kept = F.filter(F.array(*[strip_chars(F.coalesce(p, F.lit("")), "_.") for p in parts]), lambda x: x != "")
    return F.lower(strip_chars(F.regexp_replace(F.array_join(kept, "_"), "[^0-9A-Za-z]+", "_"), "_"))


def sanitize_label(c: Column, cap: int = 256) -> Column:
    """Control characters out, cut to `cap` characters, then HTML-escaped."""
    c = F.substring(F.regexp_replace(c, r"[\x00-\x1f\x7f]", ""), 1, cap)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def word_count(c: Column) -> Column:
    """Number of words between Unicode white space."""
    return F.coalesce(F.size(F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")), F.lit(0)).cast("long")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Lower-case file type without the dot; '' where there is none (a leading dot is none)."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def is_noise_dir(part: Column) -> Column:
    return part.isin(SKIPPED_DIRS) | part.rlike(NOISE_SUFFIX)


def in_noise_dir(path: Column) -> Column:
    """Whether any folder on the path is noise or hidden."""
    parts = F.split(path, "/")
    return F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: is_noise_dir(x) | x.startswith("."))


def is_sensitive(path: Column) -> Column:
    """Whether name or path hints at secrets; one pattern of them regards case."""
    name, hit = file_name(path), F.lit(False)
    for pattern, ignore in SENSITIVE:
        hit = hit | name.rlike(_rx(pattern, ignore)) | path.rlike(_rx(pattern, ignore))
    return hit


def paper_score(text: Column) -> Column:
    """How many marks of a paper its first 3000 characters hold."""
    head = F.substring(F.coalesce(text, F.lit("")), 1, 3000)
    return sum((head.rlike(_rx(p, i)).cast("int") for p, i in PAPER_MARKS), F.lit(0))


def classify(path: Column, text: Column | None = None) -> Column:
    """code, paper, image, document, or null for files that are not read; a document with three marks of a paper is one."""
    ext = suffix(path)
    doc = F.when(paper_score(text) >= 3, "paper").otherwise("document") if text is not None else F.lit("document")
    return F.when(ext.isin(CODE), "code").when(ext.isin(PAPER), "paper").when(ext.isin(IMAGE), "image").when(ext.isin(DOCUMENT), doc)


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.expr("0") + F.floor(F.length(text) / 4)).cast("long")


def safe_filename(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("/"), F.lit("-")), F.lit(" "), F.lit("_")), F.lit(":"), F.lit("-"))


def query_slug(question: Column) -> Column:
    """Lower-case file-name part of a question: its first 50 characters, other than word characters to `_`, outer `_` gone."""
    return strip_chars(F.substring(F.regexp_replace(F.lower(question), r"(?U)[^\w]", "_"), 1, 50), "_")


def file_category(path: Column) -> Column:
    """code, paper, image or doc by what follows the last dot."""
    ext = F.when(F.contains(path, F.lit(".")), F.lower(F.substring_index(path, ".", -1))).otherwise("")
    return F.when(ext.isin(sorted(set(CODE) - {"cc", "cxx", "hpp", "kts", "swift"})), "code").when(ext.isin(PAPER), "paper").when(ext.isin(IMAGE), "image").otherwise("doc")


def top_dir(path: Column) -> Column:
    return F.split(path, "/")[0]
