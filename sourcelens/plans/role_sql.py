"""Hosts, registrable domains and page roles in SQL, of a column url."""

from __future__ import annotations

from sourcelens import config as C

AUTHORITY = r"regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://([^/?#]*))?', 1)"
SUFFIXES = ", ".join(f"'{s}'" for s in C.TWO_LABEL_SUFFIXES)


def domain(host: str) -> str:
    p = f"string_split(regexp_replace(lower({host}), '^www\\.', ''), '.')"
    return f"CASE WHEN len({p}) >= 3 AND array_to_string({p}[-2:], '.') IN ({SUFFIXES}) THEN array_to_string({p}[-3:], '.') ELSE array_to_string({p}[-2:], '.') END"
PATH = r"lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1))"
QUERY = r"regexp_extract(url, '^[^?#]*\?([^#]*)', 1)"
HOST = f"regexp_replace(lower({AUTHORITY}), '^www\\.', '')"



def _m(t: str, p: str) -> str:
    return f"regexp_matches({t}, '{p}')"


_BARE = f"trim({PATH}, '/')"
_BLOB = f"CASE WHEN {QUERY} <> '' THEN {PATH} || '?' || {QUERY} ELSE {PATH} END"
_LOWER = f"lower({AUTHORITY})"
DIRECTORY = f"({_m(PATH, C.DIRECTORY_PATH)} OR ({_BARE} <> '' AND NOT contains({_BARE}, '/') AND {_m(_BARE, 'forums?$')}))"
VIDEO = f"({_m(_LOWER, C.VIDEO_HOST)} AND CASE WHEN {_LOWER} = 'youtu.be' OR ends_with({_LOWER}, '.youtu.be') THEN {_BARE} <> '' AND NOT contains({_BARE}, '/') ELSE {_m(PATH, C.VIDEO_PATH)} END)"
THREAD = f"({_m(PATH, C.THREAD_PATH)} OR {_m(_BLOB, C.THREAD_PATH)} OR {_m(_BLOB, C.FORUM_QUERY)})"
PUBLISH = _m(PATH, C.PUBLISH_PATH)
OPEN_POSTING = f"({_m(HOST, C.FORUM_HOST)} OR ({_m(HOST, '^forums?[.]')} AND NOT {DIRECTORY}) OR {THREAD} OR {_m(PATH, C.SOCIAL_PATH)} OR {VIDEO})"


def page_role(more: str = "") -> str:
    """The role of a column url; more: WHEN ... THEN ... for what the page itself tells."""
    return f"""CASE WHEN ends_with({HOST}, '.gov') OR ends_with({HOST}, '.edu') THEN 'institutional' WHEN {OPEN_POSTING} THEN 'ugc_thread'
      WHEN {_m(PATH, C.PICKS_PATH)} THEN 'editorial' WHEN {_m(PATH, C.REVIEW_PATH)} THEN 'review_profile' WHEN {DIRECTORY} THEN 'expert_listicle'
      WHEN {PUBLISH} OR {_m(PATH, r"/newsletter\b")} THEN 'expert_listicle' WHEN {_m(PATH, C.PRODUCT_PATH)} THEN 'commercial_product'
      WHEN {_m(PATH, C.SPEC_PATH)} OR starts_with({HOST}, 'psref.') THEN 'commercial_product' {more} ELSE 'factual_blog' END"""
