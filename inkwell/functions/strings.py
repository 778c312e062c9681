"""Names, paths, labels and file kinds as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions by kind.
ARCHIVES = ("zip", "rar", "7z", "tar", "gz", "tgz", "bz2", "tbz", "xz", "txz", "cab", "arj", "lzh", "z")
IMAGES = ("png", "jpg", "jpeg", "tif", "tiff", "bmp", "webp")
#: Documents that are zip files by nature, office files first, then open documents, then others.
ZIP_DOCUMENTS = (
    "docx", "docm", "dotx", "dotm",
    "xlsx", "xlsm", "xltx", "xltm", "xlsb",
    "pptx", "pptm", "potx", "potm", "ppsx", "ppsm",
    "vsdx", "vsdm",
    "odt", "ods", "odp", "odg", "odf", "odb",
    "jar", "war", "ear", "apk", "ipa", "epub", "xpi", "crx",
    "whl", "egg", "kmz", "3mf", "numbers", "pages", "key",
)
#: Suffixes of archives by kind, hexadecimal magics by kind, and later volumes of a set.
ARCHIVE_SUFFIXES = {"zip": (".zip",), "tar": (".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tbz", ".tar.xz", ".txz"), "rar": (".rar",)}
ARCHIVE_MAGICS = (
    ("zip", "504B0304"), ("zip", "504B0506"), ("zip", "504B0708"), ("tar", "1F8B"), ("tar", "425A68"), ("tar", "FD377A585A00"), ("7z", "377ABCAF271C"), ("rar", "526172211A07"),
)
LATER_VOLUME = r"(?i)(\.part0*([2-9]|[0-9]{2,})\.rar|\.r[0-9]{2}|\.z[0-9]{2})$"
#: Hexadecimal magics of containers and images.
CONTAINER_MAGICS = {"zip": "504B0304", "rar": "526172211A07", "gzip": "1F8B", "7z": "377ABCAF271C", "ole": "D0CF11E0A1B11AE1"}
IMAGE_MAGICS = ("89504E470D0A1A0A", "FFD8FF", "49492A00", "4D4D002A", "424D")


def extension(path: Column) -> Column:
    """Lower-case extension without its dot, "" where there is none."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def sniffed_kind(content: Column) -> Column:
    """Kind from the first KiB: containers are ruled out first, then PDF anywhere in it, then images."""
    head = F.substring(content, 1, 1024)
    digits = F.hex(F.substring(content, 1, 16))
    container = F.lit(False)
    for magic in CONTAINER_MAGICS.values():
        container = container | digits.startswith(magic)
    image = digits.startswith("52494646") & (F.substring(digits, 17, 8) == "57454250")
    for magic in IMAGE_MAGICS:
        image = image | digits.startswith(magic)
    return F.when(container, F.lit(None)).when(F.instr(head.cast("string"), "%PDF-") > 0, "pdf").when(image, "image")


def archive_kind(name: Column) -> Column:
    """zip, tar or rar by a name's end, else null."""
    low = F.lower(name)
    found = F.lit(None).cast("string")
    for kind, suffixes in ARCHIVE_SUFFIXES.items():
        for suffix in suffixes:
            found = F.when(low.endswith(suffix), kind).otherwise(found)
    return found


def sniffed_archive(content: Column) -> Column:
    """The kind of an archive by its first bytes; a compressed stream counts as tar. Null for all else."""
    digits = F.hex(F.substring(content, 1, 8))
    tests = [(kind, digits.startswith(magic)) for kind, magic in ARCHIVE_MAGICS]
    tests.insert(3, ("tar", F.substring(content, 258, 5) == F.lit(b"ustar")))
    found = F.lit(None).cast("string")
    for kind, test in reversed(tests):
        found = F.when(test, kind).otherwise(found)
    return found


def is_zip_document(name: Column) -> Column:
    return extension(name).isin(*ZIP_DOCUMENTS)


def is_later_volume(name: Column) -> Column:
    """Later volumes are opened through the first one."""
    return name.rlike(LATER_VOLUME)


def container_kind(name: Column, content: Column) -> Column:
    """What an archive is by its name, else by its content; null for zip-based documents, later volumes and all else."""
    return F.when(~is_zip_document(name) & ~is_later_volume(name), F.coalesce(archive_kind(name), sniffed_archive(content)))


def archive_stem(name: Column) -> Column:
    """A name without its longest archive suffix, else without its extension."""
    suffixes = sorted((s for each in ARCHIVE_SUFFIXES.values() for s in each), key=len, reverse=True)
    longest = "|".join(s.replace(".", r"\.") for s in suffixes)
    return F.when(archive_kind(name).isNotNull(), F.regexp_replace(name, f"(?i)({longest})$", "")).otherwise(F.regexp_replace(name, r"(?<=[^/.])\.[^./]*$", ""))


def classified(path: Column, content: Column) -> Column:
    """struct(kind, how): by extension, else by content; archives and unknown files have no kind."""
    ext = extension(path)
    sniffed = sniffed_kind(content)
    none = F.lit(None).cast("string")
    kind = F.when(ext.isin(*ARCHIVES), none).when(ext == "pdf", "pdf").when(ext.isin(*IMAGES), "image").otherwise(sniffed)
    how = F.when(ext.isin(*ARCHIVES), none).when((ext == "pdf") | ext.isin(*IMAGES), "extension").when(sniffed.isNotNull(), "content")
    return F.struct(kind.alias("kind"), how.alias("how"))


def safe_name(path: Column) -> Column:
    """Path without extension; slashes become two underscores, spaces one."""
    return F.replace(F.replace(F.regexp_replace(path, r"\.[^./]+$", ""), F.lit("/"), F.lit("__")), F.lit(" "), F.lit("_"))


def safe_stem(name: Column, length: int = 120) -> Column:
    return F.substring(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), 1, length)


def clean_literal(value: Column) -> Column:
    """A literal without its round brackets and line breaks; null where nothing is left."""
    inner = F.regexp_replace(value, r"^\((.*)\)$", "$1")
    return F.nullif(F.trim(F.regexp_replace(inner, r"[\r\n]+", " ")), F.lit(""))


def object_number(ref: Column) -> Column:
    """12 from "12 0 R", else null."""
    return F.regexp_extract(ref, r"^\s*(\d+)\s+\d+\s+R\s*$", 1).try_cast("int")


def writer_of(path: Column) -> Column:
    """What stands before the first underscore of a path's last part."""
    return F.substring_index(F.substring_index(path, "/", -1), "_", 1)


def human_size(size: Column) -> Column:
    """Bytes in the largest unit of 1024 that leaves at least 1: whole bytes, one decimal above."""
    value = size.cast("double")
    units = ("B", "KB", "MB", "GB", "TB")
    text = F.format_string("%.1f TB", F.bround(value / F.lit(1024.0**4), 1))
    for i in (3, 2, 1):
        text = F.when(value < 1024.0 ** (i + 1), F.format_string(f"%.1f {units[i]}", F.bround(value / F.lit(1024.0**i), 1))).otherwise(text)
    return F.when(value < 1024, F.format_string("%d B", size.cast("long"))).otherwise(text)


def percent(value: Column) -> Column:
    """One decimal; halves go to the even digit."""
    return F.format_string("%.1f%%", F.bround(value * 100, 1))


def mark_id(pdf: Column, page: Column, number: Column) -> Column:
    """Id of a mark; its tail is a digest of the rest, so that reruns agree."""
    stem = F.format_string("%s_page%03d_sig%03d", pdf, page, number)
    return F.concat_ws("_", stem, F.substring(F.sha2(stem, 256), 1, 8))


def joined_distinct(values: Column, separator: str = ";", length: int = 500) -> Column:
    """Sorted distinct values as one text of at most ``length`` characters."""
    return F.substring(F.array_join(F.array_sort(F.array_distinct(values)), separator), 1, length)


def count_of(text: Column, part: str) -> Column:
    """Occurrences of a part that don't overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def warning_lines(text: Column, length: int = 500) -> Column:
    """Distinct lines in their order, joined by " | "."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.substring(F.array_join(F.array_distinct(lines), " | "), 1, length)


def pair_label(a: Column, b: Column) -> Column:
    return F.concat_ws(" vs ", a, b)


def pair_parts(label: Column) -> Column:
    return F.split(label, " vs ", 2)


def number_or_text(value: Column) -> Column:
    """The whole number in a text as text, else the text, "" for null."""
    return F.coalesce(value.try_cast("bigint").cast("string"), value, F.lit(""))


def data_url(content: Column, kind: str = "image/png") -> Column:
    return F.concat(F.lit(f"data:{kind};base64,"), F.base64(content))


def iso_seconds(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
