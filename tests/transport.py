"""Recorded answers in place of the network."""

import json


def boards(url, params):
    slug = url.split("/boards/")[-1].split("/")[0] if "/boards/" in url else url.rpartition("/")[2]
    if slug == "gone":
        return 404, ""
    if slug == "busy":
        raise OSError("reset")
    if "lever" in url:
        return 200, json.dumps({"data": [{"id": "1", "text": f"Baker at {slug}"}]})
    return 200, json.dumps({"jobs": [{"id": 7, "title": f"Miller at {slug}", "content": params["content"]}]})


def search(url, params):
    country, what = url.split("/")[-3], params["what"]
    if country == "fr":
        return 401, ""
    if what == "odd":
        return 500, ""
    found = [{"id": "1", "title": f"{what} {country}", "redirect_url": "u"}, {"title": "no id", "redirect_url": "u", "company": {"display_name": "C"}}]
    return 200, json.dumps({"results": found[: params["results_per_page"]], "asked": sorted(params)})


def leaky(url, params):
    raise OSError(f"{url} with {params['app_key']}")
