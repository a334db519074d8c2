"""String expressions for function names, source text and paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The C and C++ library names that count as input/output calls.
IO_CALLS = (
    "fopen", "freopen", "fclose", "fflush", "fwide", "setbuf", "setvbuf", "fread", "fwrite", "getc",
    "fgetc", "fgets", "putc", "fputc", "fputs", "getchar", "gets", "putchar", "puts", "ungetc",
    "fgetwc", "getwc", "fgetws", "fputwc", "putwc", "fputws", "ungetwc", "getwchar", "putwchar",
    "scanf", "fscanf", "sscanf", "printf", "fprintf", "sprintf", "snprintf", "vprintf", "vfprintf",
    "vsprintf", "vsnprintf", "vscanf", "vfscanf", "vsscanf", "wscanf", "fwscanf", "swscanf",
    "wprintf", "fwprintf", "swprintf", "vfwprintf", "vswprintf", "vwprintf", "vwscanf", "vfwscanf",
    "vswscanf", "ftell", "fseek", "rewind", "fgetpos", "fsetpos", "clearerr", "feof", "ferror",
    "perror", "remove", "rename", "tmpfile", "tmpnam", "tmpnam_r", "read", "write", "open", "close",
    "lseek", "ioctl", "cin", "cout", "cerr", "clog", "getline", "ifstream", "ofstream",
)

# Every code point Python's str.strip() removes, as a regex class
# that Java and RE2 both read.
SPACE_CLASS = (
    r"[\t\n\x0b\x0c\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def strip(text: Column) -> Column:
    """Remove leading and trailing white space, Unicode included."""
    return F.regexp_replace(text, rf"\A{SPACE_CLASS}+|{SPACE_CLASS}+\z", "")


def clean_name(name: Column, *, stripped: bool = True, lower: bool = False) -> Column:
    """Normalise a function name: strip, lower-case, or both."""
    if stripped:
        name = strip(name)
    return F.lower(name) if lower else name


def canonical_suffix(name: Column, marker: str = "_noDict_", suffix: str = "generic") -> Column:
    """Replace what follows the last ``marker`` by ``suffix``; other names stay."""
    return F.regexp_replace(name, f"(?s)^(.*){marker}.*$", f"$1{marker}{suffix}")


def simple_function_name(signature: Column) -> Column:
    """Bare name in a signature: no arguments, scope, return type or ``*&``."""
    head = strip(F.substring_index(signature, "(", 1))
    scoped = strip(F.substring_index(head, "::", -1))
    word = F.regexp_extract(scoped, r"(\S+)\z", 1)
    return F.ltrim(word, F.lit("*&"))


def squash_whitespace(text: Column) -> Column:
    """Strip, delete line feeds and tabs, collapse runs of blanks."""
    return F.regexp_replace(F.regexp_replace(strip(text), r"[\n\t]", ""), " +", " ")


def name_prefix(name: Column) -> Column:
    """Text before the first underscore, else the first five characters."""
    return F.when(F.contains(name, F.lit("_")), F.substring_index(name, "_", 1)).otherwise(
        F.substring(name, 1, 5)
    )


def id_from_path(path: Column) -> Column:
    """Trailing integer of a directory name; null where there is none."""
    return F.regexp_extract(path, r"(\d+)/*$", 1).try_cast("int")


def path_sort_key(path: Column, missing: int = 999999) -> Column:
    """Sort key that puts directories without a number last."""
    return F.coalesce(id_from_path(path), F.lit(missing))


def is_io_call(name: Column) -> Column:
    """True for a name in the fixed list of input/output calls."""
    return name.isin(*IO_CALLS)


def function_filter(df: DataFrame, name: str, wanted: DataFrame | None) -> DataFrame:
    """Keep rows whose simple name, case-insensitively, is in ``wanted``.

    ``wanted`` has one column of names; ``None`` keeps everything.
    """
    if wanted is None:
        return df
    keys = wanted.select(F.lower(F.col(wanted.columns[0])).alias("_wanted")).distinct()
    probe = df.withColumn("_wanted", F.lower(simple_function_name(F.col(name))))
    return probe.join(keys, "_wanted", "left_semi").drop("_wanted")
