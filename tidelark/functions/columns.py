"""Scalar functions as Column expressions: paths, sizes, dates, scores, JSON."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BYTES_PER_LINE = 50

# Languages by extension and by file name, and what is never analysed; callers add folders and names of their own.
EXTENSION_LANGUAGES = {".py": "Python", ".js": "JavaScript", ".ts": "TypeScript", ".tsx": "TSX", ".jsx": "JSX", ".java": "Java", ".go": "Go", ".rs": "Rust", ".rb": "Ruby", ".php": "PHP", ".c": "C", ".cpp": "C++", ".cc": "C++", ".h": "Header", ".hpp": "C++", ".cs": "C#", ".swift": "Swift", ".kt": "Kotlin", ".scala": "Scala", ".r": "R", ".R": "R", ".sql": "SQL", ".sh": "Shell", ".bash": "Shell", ".zsh": "Shell", ".yml": "YAML", ".yaml": "YAML", ".json": "JSON", ".xml": "XML", ".html": "HTML", ".htm": "HTML", ".css": "CSS", ".scss": "SCSS", ".sass": "Sass", ".less": "Less", ".md": "Markdown", ".txt": "Text", ".rst": "reStructuredText"}
NAME_LANGUAGES = {"Dockerfile": "Dockerfile", "Makefile": "Makefile", "CMakeLists.txt": "CMake", "Gemfile": "Ruby", "Rakefile": "Ruby", "package.json": "JSON", "requirements.txt": "Text", "setup.py": "Python", "pyproject.toml": "TOML", "Cargo.toml": "TOML", "go.mod": "Go Module", ".gitignore": "Ignore List", ".dockerignore": "Ignore List"}
# Languages whose symbols are known, by extension.
SYMBOL_LANGUAGES = {".go": "GO", ".mod": "GO", ".c": "C", ".cpp": "CPP", ".cc": "CPP", ".cxx": "CPP", ".c++": "CPP", ".h": "C_OR_CPP_HEADER", ".hpp": "C_OR_CPP_HEADER", ".hh": "C_OR_CPP_HEADER", ".hxx": "C_OR_CPP_HEADER", ".h++": "C_OR_CPP_HEADER", ".py": "PYTHON", ".pyw": "PYTHON", ".pyi": "PYTHON", ".v": "VERILOG", ".sv": "VERILOG", ".rs": "RUST", ".s": "ASSEMBLY", ".S": "ASSEMBLY", ".asm": "ASSEMBLY", ".nasm": "ASSEMBLY", ".inc": "ASSEMBLY", ".java": "JAVA", ".rb": "RUBY", ".rbi": "RUBY", ".cs": "C_SHARP", ".ts": "TYPESCRIPT", ".tsx": "TYPESCRIPT", ".js": "JAVASCRIPT", ".jsx": "JAVASCRIPT"}
BLACKLIST_DIRS = [".git"]
BLACKLIST_EXTENSIONS = [".svg", ".hex", ".bin", ".BIN", ".dat", ".DAT", ".exe", ".o", ".a", ".so", ".dll", ".dylib", ".cdylib", ".axf", ".elf"]
BLACKLIST_NAMES = [".DS_Store"]
HEX_SHARE = 0.99


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Sizes


def bytes_to_sloc(b: Column | str) -> Column:
    """Lines of code that so many bytes stand for; the sign is dropped."""
    return F.floor(F.abs(col(b)) / BYTES_PER_LINE).cast("long")


def bytes_per_line(patch_bytes: Column | str, churn_lines: Column | str) -> Column:
    return F.when(col(churn_lines) > 0, col(patch_bytes) / col(churn_lines)).otherwise(F.lit(0.0))


def size_category(churn: Column | str) -> Column:
    c = col(churn)
    return F.when(c < 10, "tiny").when(c < 50, "small").when(c < 200, "medium").otherwise("large")


def is_refactor(additions: Column | str, deletions: Column | str) -> Column:
    a, d = col(additions), col(deletions)
    return (a > 0) & (d > 0) & (F.abs(a - d) < 0.1 * (a + d))


def line_count(text: Column | str) -> Column:
    """Line feeds, and one more for a last line without one."""
    t = col(text)
    feeds = F.length(t) - F.length(F.translate(t, "\n", ""))
    return (feeds + F.when((F.length(t) > 0) & ~F.endswith(t, F.lit("\n")), 1).otherwise(0)).cast("long")


def safe_ratio(a: Column | str, b: Column | str) -> Column:
    return F.coalesce(col(a) / F.nullif(col(b), F.lit(0)), F.lit(0.0))


def clamp(x: Column | str) -> Column:
    return F.greatest(col(x), F.lit(0))


# Paths


def file_name(path: Column | str) -> Column:
    return F.element_at(F.split(col(path), "/"), -1)


def suffix(path: Column | str) -> Column:
    """The last dot and what follows it in the file name; none for dot files and names that end in a dot."""
    return F.regexp_extract(file_name(path), r"^\.*[^.].*?(\.[^.]+)$", 1)


def naive_extension(path: Column | str) -> Column:
    """What follows the last dot of the whole path, with a dot before it; null without one."""
    return F.when(F.contains(col(path), F.lit(".")), F.concat(F.lit("."), F.substring_index(col(path), ".", -1)))


def directory_of(path: Column | str) -> Column:
    """The first two directories of a path; root for files outside any."""
    parts = F.split(col(path), "/")
    n = F.size(parts)
    return F.when(col(path).isNull() | (col(path) == "") | (n <= 1), "root").when(n == 2, parts[0]).otherwise(F.concat_ws("/", parts[0], parts[1]))


def ancestors(path: Column | str) -> Column:
    """All directories above a path, the empty root first."""
    parts = F.split(col(path), "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def depth(path: Column | str) -> Column:
    p = col(path)
    return F.when((p == "") | (p == "/"), 0).otherwise(F.size(F.split(F.trim(p, F.lit("/")), "/"))).cast("int")


def parent(path: Column | str) -> Column:
    return F.when(F.contains(col(path), F.lit("/")), F.regexp_replace(col(path), "/[^/]*$", "")).otherwise(F.lit(""))


def with_slash(path: Column | str) -> Column:
    p = col(path)
    return F.when((p == "") | F.endswith(p, F.lit("/")), p).otherwise(F.concat(p, F.lit("/")))


def language_of(path: Column | str) -> Column:
    """Language by extension, then by file name; null if neither is known."""
    tables = [F.create_map(*(F.lit(x) for kv in t.items() for x in kv)) for t in (EXTENSION_LANGUAGES, NAME_LANGUAGES)]
    return F.coalesce(F.try_element_at(tables[0], suffix(path)), F.try_element_at(tables[1], file_name(path)))


def symbol_language(path: Column | str) -> Column:
    """The language whose symbols a file has, by its extension; DEFAULT for all others."""
    known = F.create_map(*[F.lit(x) for pair in SYMBOL_LANGUAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, suffix(path)), F.lit("DEFAULT"))


def is_analyzable(path: Column | str, directories: tuple[str, ...] = (), file_names: tuple[str, ...] = ()) -> Column:
    """Cheap tests first: directories, then extension, then name."""
    return ~F.arrays_overlap(F.split(col(path), "/"), F.array(*map(F.lit, [*BLACKLIST_DIRS, *directories]))) & ~suffix(path).isin(BLACKLIST_EXTENSIONS) & ~file_name(path).isin([*BLACKLIST_NAMES, *file_names])


def is_hex(text: Column | str) -> Column:
    """More than 99 % of the characters are hexadecimal digits, line feeds or spaces."""
    t = col(text)
    return F.when(F.length(t) == 0, False).otherwise(F.length(F.regexp_replace(t, r"[^a-fA-F0-9\n ]", "")) / F.length(t) > HEX_SHARE)


#: Control characters that texts don't have, as a range of a pattern.
CONTROLS = r"\x00-\x08\x0e-\x1b"


def looks_binary(text: Column | str) -> Column:
    """Control characters that texts don't have."""
    return F.regexp_like(col(text), F.lit(f"[{CONTROLS}]"))


def content_encoding(content: Column | str) -> Column:
    """utf-8, utf-16le, utf-16be or other (8 bits a character) of a file's bytes; null for a binary file.

    Bytes of a control character rule out all but UTF-16, which is taken for such by its mark, or by zeros in nine tenths of one of
    its two bytes, if no control character or broken pair is left when it is decoded.
    """
    c = col(content)
    byte = F.decode(c, "ISO-8859-1")
    bad = F.regexp_like(byte, F.lit(f"[{CONTROLS}]"))
    firsts, seconds = F.regexp_replace(byte, r"(?s)(.)(.)?", "$1"), F.regexp_replace(byte, r"(?s)(.)(.?)", "$2")
    zeros = lambda x: (F.length(x) - F.length(F.translate(x, "\x00", ""))) / F.greatest(F.lit(1), F.length(x))
    little = F.startswith(byte, F.lit("\u00ff\u00fe")) | (zeros(seconds) >= 0.9)
    big = F.startswith(byte, F.lit("\u00fe\u00ff")) | (zeros(firsts) >= 0.9)
    even = F.length(byte) % 2 == 0

    def clean(name: str) -> Column:
        # The high bytes tell surrogates: each first half is followed by a second one, and no second one stands alone.
        broken = F.regexp_like(firsts if name == "UTF-16BE" else seconds, F.lit(r"[\xd8-\xdb](?![\xdc-\xdf])|(?<![\xd8-\xdb])[\xdc-\xdf]"))
        control = r"\x00[\x00-\x08\x0e-\x1b]" if name == "UTF-16BE" else r"[\x00-\x08\x0e-\x1b]\x00"
        return even & ~broken & ~F.regexp_like(byte, F.lit(rf"(?s)\A(?:..)*{control}"))

    wide = F.when(little & clean("UTF-16LE"), "utf-16le").when(big & clean("UTF-16BE"), "utf-16be")
    return F.when(bad | little | big, wide).when(F.is_valid_utf8(c), "utf-8").otherwise("other")


# Strings


def qualified_name(above: Column | str, delimiter: Column | str, name: Column | str) -> Column:
    return F.when(col(above).isNull() | (col(above) == ""), col(name)).otherwise(F.concat(col(above), col(delimiter), col(name)))


def local_branch(name: Column | str) -> Column:
    """A remote branch without the remote's name; null for HEAD."""
    n = F.regexp_replace(col(name), "^[^/]*/", "")
    return F.when(F.upper(n) != "HEAD", n)


def user_key(user_id: Column | str) -> Column:
    """Identity-provider ids as provider|id; a bare id belongs to the default provider."""
    return F.when(F.contains(col(user_id), F.lit("|")), col(user_id)).otherwise(F.concat(F.lit("auth0|"), col(user_id)))


def words(text: Column | str) -> Column:
    """Tokens for keyword search: words with underscores and one inner apostrophe."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit(r"(?U)\b[\w_]+(?:'[\w_]+)?\b"), F.lit(0))


def spaced(name: Column | str) -> Column:
    return F.translate(col(name), "_", " ")


def markdown_escaped(text: Column | str) -> Column:
    return F.regexp_replace(col(text), r"([\\`*_{}\[\]()#+.!|-])", r"\\$1")


def markdown_links(text: Column | str) -> Column:
    """Targets of [label](target) links."""
    return F.regexp_extract_all(col(text), F.lit(r"\[[^\]]*\]\(([^)]+)\)"), F.lit(1))


def org_bucket(org: Column | str) -> Column:
    return F.left(F.sha2(col(org), 256), F.lit(63))


def object_location(url: Column | str) -> Column:
    """Bucket and key of a presigned URL."""
    u = col(url)
    key = F.url_decode(F.regexp_replace(F.parse_url(u, F.lit("PATH")), "^/", ""))
    return F.struct(F.split(F.parse_url(u, F.lit("HOST")), r"\.")[0].alias("bucket"), key.alias("key"))


def line_window(text: Column | str, start: Column, end: Column, around: int = 0) -> Column:
    """Lines start to end (from 1) with so many more on either side."""
    lines = F.split(col(text), "\n")
    first = F.greatest(F.lit(1), start - around)
    return F.array_join(F.slice(lines, first, F.greatest(F.lit(0), F.least(F.size(lines), end + around) - first + 1)), "\n")


# Dates


def month(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def within_days(ts: Column | str, as_of: Column, days: int) -> Column:
    return col(ts) >= as_of - F.expr(f"INTERVAL {days} DAYS")


# Scores


def l2(a: Column | str, b: Column | str) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(col(a), col(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def semantic_score(distance: Column | str) -> Column:
    """(1 - |1 - d|) cubed, 0 at least: best at distance 1."""
    x = F.lit(1.0) - F.abs(F.lit(1.0) - col(distance))
    return F.greatest(F.lit(0.0), x * x * x)


def keyword_score(bm25: Column | str) -> Column:
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.lit(1.0) / (F.lit(1.0) + col(bm25)))


def weighted_mean(*scores: tuple[Column, float]) -> Column:
    """Mean by weight of those that aren't null."""
    total = reduce(lambda a, b: a + b, [F.when(s.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for s, w in scores])
    summed = reduce(lambda a, b: a + b, [F.coalesce(s * w, F.lit(0.0)) for s, w in scores])
    return F.when(total > 0, summed / total).otherwise(F.lit(0.0))


# JSON


def json_path(column: Column | str, path: str) -> Column:
    """A dotted path into a JSON string."""
    return F.get_json_object(col(column), "$." + path)


def json_has_key(column: Column | str, key: str) -> Column:
    return F.array_contains(F.json_object_keys(col(column)), key)


def ordered_keys(column: Column | str, n: int = 3) -> Column:
    """The keys of a JSON object of numbers, the greatest number first, then by name; the first n.  Null for none."""
    scores = F.map_entries(F.from_json(col(column), "map<string,string>"))
    ordered = F.array_sort(F.transform(scores, lambda e: F.struct((-e["value"].cast("double")).alias("score"), e["key"].alias("key"))))
    return F.when(F.size(scores) > 0, F.slice(F.transform(ordered, lambda e: e["key"]), 1, n))


def json_or(column: Column | str, key: Column, default: str) -> Column:
    """The value of a computed key of a JSON object, or the default where there is none."""
    return F.coalesce(F.try_element_at(F.from_json(col(column), "map<string,string>"), key), F.lit(default))


# Hashes


def content_hash(text: Column | str) -> Column:
    """SHA-256 of a text in UTF-8, lowercase hex."""
    return F.sha2(col(text).cast("binary"), 256)


def config_hash(text: Column | str) -> Column:
    """The first 16 characters of a configuration's content hash."""
    return F.left(content_hash(text), F.lit(16))


def stable_id(kind: Column | str, node: Column | str, needs: Column | str) -> Column:
    """Id of a task by its kind, its node and the ids of the tasks that it needs, in their order."""
    own = F.concat_ws("_", col(kind), col(node))
    return F.when(F.size(col(needs)) > 0, F.concat(own, F.lit("_"), F.array_join(col(needs), "_"))).otherwise(own)


# Numbers


def round_half_even(x: Column | str, digits: int = 2) -> Column:
    """The nearest number of so many digits (0 to 8) to the exact binary value; only a true tie goes to the even digit.

    The product's rounding error is had from x in two halves of which each product is exact; it decides where the product alone
    looks like a tie.
    """
    v, scale = col(x).cast("double"), float(10**digits)
    high = v * 134217729.0 - (v * 134217729.0 - v)
    p = v * scale
    error = (high * scale - p) + (v - high) * scale
    low = F.floor(p).cast("double")
    past = p - low - 0.5
    up = (past > 0) | ((past == 0) & ((error > 0) | ((error == 0) & (F.pmod(low, F.lit(2.0)) == 1))))
    n = F.when(up, low + 1.0).otherwise(low)
    return F.when(F.isnan(v) | (F.abs(p) >= 2.0**52), v).otherwise(n / scale)


def scale_factor(files: Column | str, pages: Column | str, threshold: int = 10_000, pages_a_file: int = 10) -> Column:
    """How many files must count as one for files and pages to stay within the threshold; 1 where they do without."""
    f, p = col(files), F.floor(col(pages) / pages_a_file)
    over = (f + col(pages) > threshold) & (f > threshold) & (p < threshold)
    return F.when(over, F.ceil(f / (threshold - p))).otherwise(F.lit(1)).cast("long")


# Checks


def zone_error(text: Column | str, name: str) -> Column:
    """What is wrong with an ISO 8601 time: it must name its zone (Z or an offset).  Null for none and for no time."""
    named = F.rlike(F.trim(col(text)), F.lit(r"[T ]\d{2}:\d{2}.*(?:[Zz]|[+-]\d{2}:?\d{2})$"))
    return F.when(col(text).isNotNull() & ~named, F.lit(f"{name} must name its time zone"))
