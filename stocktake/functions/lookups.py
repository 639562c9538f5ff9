"""Fixed lookup values and our own explanations of cleanup kinds."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# fixed values: extensions of each category
CATEGORIES = {
    "Archives": "zip zipx rar 7z tar tgz gz bz bz2 tbz tbz2 xz txz zst tzst lz4",
    "Audio": "aif aiff flac m4a mp3 wav",
    "Databases": "db realm sqlite sqlite3",
    "Developer": "app bundle framework h json m mm pbxproj plist sh swift xcarchive xcodeproj xcworkspace yml yaml",
    "Documents": "csv doc docx key md numbers pages pdf ppt pptx rtf txt xls xlsx",
    "Fonts": "otf ttc ttf woff woff2",
    "Images": "gif heic jpeg jpg png psd raw tif tiff webp",
    "Installers": "dmg ipsw iso mpkg pkg sparsebundle sparseimage toast xip",
    "Video": "avi m4v mkv mov mp4 mpeg mpg wmv",
    "Virtual Machines": "qcow2 vbox vdi vhd vhdx vmdk vmwarevm pvm",
}
# fixed values: names and extensions of the cleanup rules
CACHE_NAMES = ("cache", "caches", ".cache")
BUILD_NAMES = ("deriveddata", "node_modules", ".build", "build", "dist", "target", ".gradle")
DISK_IMAGES = ("dmg", "iso", "toast", "sparsebundle", "sparseimage")
INSTALLERS = ("pkg", "mpkg", "xip", "ipsw")
ARCHIVES = tuple(CATEGORIES["Archives"].split())
TEMPORARY = ("tmp", "temp", "bak", "old")
OLD_LARGE_BYTES = 1_000_000_000
CONFIDENCES = ("high", "medium", "review")
# fixed values: how confidences are shown
CONFIDENCE_LABELS = {"high": "Verified", "medium": "Review", "review": "Manual"}

#: kind: (confidence, why it is listed, what could go wrong, what is safe, what to do)
TRUST = {
    "verifiedDuplicate": ("high", "Its bytes equal those of a kept file.", "Programs that expect this very path.", "One copy stays.", "Remove the copy."),
    "oldLargeFile": ("review", "It is large and has long been unchanged.", "It may be the only copy.", "Nothing was read.", "Open it before deciding."),
    "archive": ("review", "It is a compressed archive.", "Its contents may exist nowhere else.", "Nothing was unpacked.", "Look for the unpacked copy."),
    "installer": ("medium", "It is an installer package.", "A later reinstallation needs it again.", "Installed programs do not use it.", "Remove it once installed."),
    "diskImage": ("medium", "It is a disk image.", "It may hold files of your own.", "Installed programs do not use it.", "Mount it and look first."),
    "cacheFolder": ("medium", "Its name is that of a cache.", "A running program may use it.", "Caches are made anew.", "Quit the program first."),
    "buildArtifact": ("medium", "Its name is that of build output.", "The next build takes longer.", "Sources are elsewhere.", "Build again when needed."),
    "temporary": ("review", "Its name is that of a temporary or backup file.", "It may be a backup that is still wanted.", "Nothing was read.", "Check its date."),
    "general": ("review", "It was picked by hand.", "Unknown.", "Nothing is assumed.", "Decide case by case."),
}


def literal_map(pairs: dict[str, str]) -> Column:
    return F.create_map(*map(F.lit, chain(*pairs.items())))


def category_of(ext: Column) -> Column:
    """Category of a lower-case extension; a literal map, so that no join is needed."""
    by_ext = {e: c for c, words in CATEGORIES.items() for e in words.split()}
    return F.coalesce(F.element_at(literal_map(by_ext), ext), F.lit("Other"))


def trust_field(kind: Column, field: int) -> Column:
    return F.element_at(literal_map({k: v[field] for k, v in TRUST.items()}), kind)
