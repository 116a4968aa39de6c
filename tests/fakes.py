"""Stand-ins for what is plugged in: an extractor and a model."""

import json


def extractor(rel_path, content):
    if content.startswith(b"broken"):
        raise ValueError("cannot read")
    text = content.decode()
    return {"metadata": {"title": text.split("\n")[0], "author": "", "creationDate": "D:2020", "producer": "p"}, "toc": [{"level": 1, "title": " One\n", "page": 1}], "pages": [text]}


def model(payload):
    asked = json.loads(payload)
    if "children" in asked:
        return {"decision": "child", "child": asked["children"][0]["name"], "confidence": "high", "reasoning": "r"}
    if "documents" in asked or "proposals" in asked:
        return {"categories": ["Rivers", "Law"], "groups": [{"name": "Rivers", "topics": ["water", "Law"]}, {"name": "law", "topics": []}]}
    return {"suggested_author": asked.get("title"), "toc_is_valid": True, "confidence": 0.5}
