"""A recorded service: pages of three rows, newest first, from a JSON file that ``RECORDED_PAGES`` names."""

import json
import os


def fetch(channel, page):
    with open(os.environ["RECORDED_PAGES"]) as lines:
        rows = sorted(json.load(lines).get(channel, []), key=lambda r: -(r.get("time") or 0))
    return rows[3 * page : 3 * page + 3]


def counted(channel, page):
    with open(os.environ["RECORDED_PAGES"] + ".log", "a") as log:
        log.write(f"{channel}:{page}\n")
    return fetch(channel, page)
