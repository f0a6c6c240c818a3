"""Search profiles: one JSON document, checked without coercion."""

from __future__ import annotations

import json

LISTS = ("target_roles", "keywords", "preferred_locations", "excluded_keywords")
TEXTS = ("display_name", "experience_level")
STORY_LISTS, STORY_TEXTS = ("actions", "results", "evidence"), ("id", "title", "period", "role")


def _texts(value: object, name: str) -> list[str]:
    if not isinstance(value, list) or not all(isinstance(x, str) and x.strip() for x in value):
        raise ValueError(f"{name} must be a list of texts that are not blank")
    return value


def read_profile(path: str) -> dict:
    """A profile with its lists, texts and stories; raises ValueError for other types, blank terms or stories with missing or repeated ids. A byte order mark is tolerated, NaN is not."""

    def refuse(word: str) -> None:
        raise ValueError(f"{word} is no JSON value")

    with open(path, encoding="utf-8-sig") as f:
        value = json.load(f, parse_constant=refuse)
    if not isinstance(value, dict):
        raise ValueError("a profile is an object")
    for name in LISTS:
        _texts(value.get(name), name)
    for name in TEXTS:
        if not isinstance(value.get(name), str):
            raise ValueError(f"{name} must be a text")
    stories = value.get("stories")
    if not isinstance(stories, list) or not all(isinstance(s, dict) for s in stories):
        raise ValueError("stories must be a list of objects")
    for story in stories:
        for name in STORY_LISTS:
            _texts(story.get(name), name)
        if not all(isinstance(story.get(n), str) for n in STORY_TEXTS) or not story["id"].strip():
            raise ValueError("a story needs its texts and an id")
    if len({s["id"] for s in stories}) < len(stories):
        raise ValueError("story ids must be unique")
    return value
