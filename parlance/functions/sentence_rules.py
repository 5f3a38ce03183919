"""Substitutions that repair sentences: joins of what a line break cut, breaks where a sentence ends."""

from __future__ import annotations

# Pattern and replacement, in the order in which they are applied (multi-line mode).
SENTENCE_RULES = [
    (r"(\([^\)]*\)|\[[^\]]+\])\s*\n\s*\.\s*", r"\1.\n"),
    (r"\n\s*(\([^\)]*\)|\[[^\]]+\])\s*", r" \1 "),
    (r"(\([^\)]*\)|\[[^\]]+\])\s*(?:\.)?\s*(?=(?:\d+\.)|(?:[ivxlcdmIVXLCDM]{1,4}\.))", r"\1.\n"),
    (r"(?m)^[ \t]*(\(\d+\)|\d+)\.\s*\n\s*([A-Z])", r"\1. \2"),
    (r"(?m)^[ \t]*(i|ii|iii|iv|v|vi|vii|viii|ix|x)\.\s*\n\s*([A-Z])", r"\1. \2"),
    (r"(?m)^[ \t]*\.[ \t]*\n", r""),
    (r"\(\s*([a-zA-Z])\s*\)\s*\n\s*to\s*\n\s*\(\s*([a-zA-Z])\s*\)", r"(\1) to (\2)"),
    (r"\(\s*([a-zA-Z])\s*\)\s*\n\s*\(\s*([a-zA-Z])\s*\)", r"(\1) (\2)"),
    (r"\(\s*([a-zA-Z])\s*\)\s*\n", r"(\1) "),
    (r"\.\s*(\((?!\d+\)|[ivxlcdmIVXLCDM]+\)|[a-zA-Z]\))[^)]*\]?\)|\[[^\]]+\])\s+(?=[A-Z])", r". \1\n"),
    (r"(?<!\b(?:\d{1,3}|[a-zA-Z]|[ivxlcdmIVXLCDM]))([.?!])\s+(?=[A-Z])", r"\1\n"),
    (r"(?<=[.?!;])\s+(?=\b(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)\.\s)", r"\n"),
    (r"(?i)(?<=[,;.\)])\s*(?=\b(?:[ivxlcdm]{1,4})\.\s+[A-Z])", r"\n"),
    (r"(?<=[.;:])\s+(?:and\s+|or\s+)?(?=(?:i|ii|iii|iv|v|vi|vii|viii|ix|x)\.\s)", r"\n"),
    (r"^(?:\s*)(i|ii|iii|iv|v|vi|vii|viii|ix|x)\.\s*\n\s*([A-Z])", r"\1. \2"),
    (r"(?<!\b[Nn]o)\.(?=\s+(?!\d+\(|\([ivxlcdm]+\)))([A-Z])", r".\n\1"),
    (r"""([.?!])\s*(?:\n\s*)?([\"\"'')])\s*([.,;:])?""", r"\1\2\3 "),
    (r"""([.?!]["'"\)]*)\s+(\d+\.|\([ivxlcdmIVXLCDM]+\)|\([a-zA-Z]\))\s+(?=[A-Z])""", r"\1\n\2 "),
    (r"(\b\d+[A-Z]?\.)\s*\n\s*([A-Z])", r"\1 \2"),
    (r"""([.?!][\"\"'')])\s+(?=[A-Z])""", r"\1\n"),
    (r"(?<!\b[Nn]o)([.?!:;])\s+(?=\(\s*(?:[ivxlcdmIVXLCDM]+|[0-9]+|[A-Za-z])\s*\)|[0-9]+\s*\)|[A-Za-z]\s*\))", r"\1\n"),
    (r'([.?!:])"\s+(?=[A-Z])', r'\1"\n'),
    (r"\b([A-Z][a-z]{1,3})\.\s*\n\s*([A-Z][a-z.]*)", r"\1. \2"),
    (r"(\d{1,2}\.\d{1,2})\s*p\.\s*\n\s*m\.", r"\1 p.m."),
    (r"(\d{1,2}\.\d{1,2})\s*a\.\s*\n\s*m\.", r"\1 a.m."),
    (r"\b(Ltd|Pvt|Co|Inc|Corp|PLC|LLC)\.", r"\1"),
    (r"\(Pvt\)\s*\n\s*(Ltd)", r"(Pvt) \1"),
    (r"\.\s*\n\(?sic\)?\s*(?=(?:[0-9]+\.|\([ivxlcdm]+\)))?", r". (sic)\n"),
    (r"\[\s*([^\[\]]*?)\n\s*([^\[\]]*?)\]", r"[\1 \2]"),
    (r"\b([ie])\.\s*\n\s*([eg])\.", r"\1.\2."),
    (r"\b(i)\.\s*e\.", r"i.e."),
    (r"\b(e)\.\s*g\.", r"e.g."),
    (r"(i\.e\.|e\.g\.)\s*\n\s*", r"\1 "),
    (r"(?mi)\n\s*(i\.e\.|e\.g\.)\s*", r" \1 "),
    (r"(?<=\b(?:[A-Z]\.){2,}\s*\([^)]+\))\s*\n\s*(?=[A-Z])", r" "),
    (r"No\.\s*\n\s*(CA|SC|HC|MC|DC|WRIT|Appeal|Revision)", r"No. \1"),
    (r"(?mi)\bNo\.\s*\n\s*(\([a-z]+\))", r"No. \1"),
    (r"(?mi)\bNo\.\s*\n\s*(\([ivxlcdm]+\))", r"No. \1"),
    (r"\b[Nn]o\.\s*\n?\s*(?=\d)", r"No. "),
    (r"([?])\s*No\.\s+(?=\()", r"\1 No.\n"),
    (r"([?])\s*No\.\s+(?=[A-Z])", r"\1 No.\n"),
    (r"(?mi)\bRs\.\s*\n\s*(\d)", r"Rs. \1"),
    (r"(?mi)\bno\.\s*\n\s*([^\s]*[0-9/][^\s]*)", r"No. \1"),
    (r"(?mi)(case(?:\s+bearing)?\s+no)\.\s*\n\s*([^\s]*[0-9/][^\s]*)", r"\1. \2"),
    (r"(?mi)\bNos\.\s*\n\s*(\d+)", r"Nos. \1"),
    (r"(?i)\bNo\.\s*\n\s*(\(?[0-9ivxlcdmIVXLCDM]+\)?)", r"No. \1"),
    (r"(?i)No\.\s*\n?\s*(\d+)\.(\s+)(?=[A-Z])", r"No. \1.\n"),
    (r"(\(\d{4}\)\.)\s*\n\s*(\d+\.\s*[A-Z])", r"\1 \2"),
    (r"(?m)\b(Dr|Mr|Mrs|Ms|Prof|Hon|Rev|Sr|Jr|Gen|Col|Capt|Lt|St)\.\s*\n\s*", r"\1. "),
    (r"((?:[A-Z]\.){2,})\s*\n\s*([A-Z][a-z]+)", r"\1 \2"),
    (r"\b([A-Z])\.\s+([A-Z])\.\s+([A-Z])\.", r"\1.\2.\3."),
    (r"\b(vs?\.?|VS\.?)\s*\n+", r"v. "),
    (r"(?m)\n(?=(?:[Vv]s?\.?|VS\.?)\s)", r" "),
    (r"\b([A-Z])\.\s*\n+", r"\1. "),
    (r"([A-Z][a-z]+,)\s*\n\s*((?:[A-Z]\.){1,}\s*[A-Z]?)", r"\1 \2"),
    (r"(?mi)\bs\.\s*\n\s*([\d][\w.\-]*)", r"s. \1"),
    (r"(?mi)\n(?=\s*(?:s\.|ss\.|sec\.)(?=\s|$|[^\w]))", r" "),
    (r"(?m)(?<=\b(?:Sec|sec)\.)\s*\n\s*", r" "),
    (r"(Section\s+\d+[A-Za-z()]*\.)\s+(?=[A-Z])", r"\1\n"),
    (r"(Sec\.\s*\d+)\.\s+(?=[A-Z])", r"\1.\n"),
    (r"(Case\s+No\.\s*[^\s]+)\.\s+(?=[A-Z])", r"\1.\n"),
    (r"(Section\s+\d+)\.\s*\n\s*(\(\d+\))", r"\1. \2"),
    (r"(?mi)\brr?\.\s*\n\s*([\d]+(?:\.\d+)*(?:\([^)]+\))*)", r"r. \1"),
    (r"(?mi)\b(Section|Sec|s)\.\s*\n\s*(\d+\(?\d*\)?)", r"\1. \2"),
    (r"(?mi)\b(Section|Sec|s)\s*\n\s*(\d+\(?\d*\)?)", r"\1 \2"),
    (r"\b(p|pg)\.\s*\n?\s*(\d+)", r"\1. \2"),
    (r"(?m)\(\s*at\s*p\.\s*\n\s*(\d+)\s*\)", r"(at p. \1)"),
    (r"(?m)at\s*\n?\s*p\.\s*(\d+)", r"at p. \1"),
    (r"(?m)pgs\.\s*\n\s*([\d,]+)", r"pgs. \1"),
    (r"\(\s*\n\s*(p\.\s*\d+(?:\s+of\s+Vol\.\s*[I1-3]+(?:\s*Book\s*\d+)?)?)\s*\)", r"(\1)"),
    (r"\(\s*\n\s*([^)]+)\)", r"(\1)"),
    (r"(?m)\(\s*([^)]*?)\s*\n\s*([^)]*?)\)", r"(\1 \2)"),
    (r"(?mi)\bat\s*p\.\s*\n\s*(\d+)", r"at p. \1"),
    (r"(?m)\(\s*at\s*pp\.\s*\n\s*([\d,\-– ]+)\s*\)", r"(at pp. \1)"),
    (r"(Vol\.\s+[IVXLCDM]+,)\s*\n\s*(p{1,2}\.\s*\d+)", r"\1 \2"),
    (r"(\bat\.)\n+(?=p\.\s*\d+)", r"\1 "),
    (r"\)\.(?=\S)", r"). "),
    (r"\)\.\s*(?=[A-Za-z])", ').\n'),
    (r"(\([^\n]*SC)\s*\n\s*(\d+)\)", r"\1 \2)"),
    (r"(\bAIR\s*(?:\(?[0-9]{4}\)?)?\s*[A-Za-z.]+)\s*\n\s*([0-9]+)\)?", r"\1 \2)"),
    (r"(\b(?:[ivxlcdm]+)\.)\n+([A-Z])", r"\1 \2"),
    (r"(\)\.?)\n+(?=(?:L\.A\.|B\.L\.R\.|S\.C\.))", r"\1 "),
    (r"(\(\(\d{4}\)\s*)\n+(?=B\.L\.R\.)", r"\1"),
    (r"(\b[Nn]o\.)\n+([A-Z0-9])", r"\1 \2"),
    (r"(\(\d{4}\))\n+(?=p\.\s*\d+)", r"\1 "),
    (r"(\(\w+\))\s*\.\n+([A-Z])", r"\1. \2"),
    (r"(et\. al\.)\n+(\d+)", r"\1 \2"),
    (r"(\b\d+\.)\n+(\(\d+\))", r"\1 \2"),
    (r"(\bArt\.)\n+(\d+)", r"\1 \2"),
    (r"(Vol\.)\s*\n+(\d+\s+at\s+pg\.\s*\d+)", r"\1 \2"),
    (r"(Vol\.)\s*\n+(\d+\s+of\s+Sri\s+Lanka\s+Law)", r"\1 \2"),
    (r"(\b\d+\.)\n+\(([a-z])\)", r"\1 (\2)"),
    (r"\b([IVXLCDM]+)\.\n+([A-Z])", r"\1. \2"),
    (r"(\bCH)\.\s*\n\s*(D\s*\d+)", r"\1.\2"),
    (r"(?mi)(SC(?:\s+SPL)?)\.\s*\n\s*(LA\s+No\.)", r"\1. \2"),
    (r"”\s+(?=\d+\.\s+[A-Z])", r"”\n"),
    (r"(CA\.)\s*\n\s*(No\.)", r"\1 \2"),
    (r"([A-Za-z])\s*\n\s*(\d+\(?\d*\)?)", r"\1 \2"),
    (r"(\d{1,2}[./\- ]\d{1,2}[./\- ]\d{2,4})\.(\s+[A-Z])", r"\1.\n\2"),
    (r"(\d{1,2}\s+(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)(\s+\d{2,4})?)\.(\s+[A-Z])", r"\1.\n\4"),
    (r"(\d{1,2}(?:st|nd|rd|th)?\s+(Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)(\s+\d{2,4})?)\.(\s+[A-Z])", r"\1.\n\4"),
    (r"(\d{1,2}(?:st|nd|rd|th)?\s+(?:of\s+)?(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)(?:uary|ruary|ch|il|e|y|e|ober|ember)?\.)\s*\n\s*(\d{2,4})", r"\1 \2"),
    (r"(\d{1,2}[./\- ]\d{1,2}[./\- ]\d{2,4})\s*\n\s*", r"\1 "),
    (r"(\d{2}\.\d{2}\.)\s*\n\s*(\d{4})", r"\1\2"),
    (r"(\d{1,2})\.\s*\n\s*(\d{2}\.\d{4})", r"\1.\2"),
    (r"(\(\d{4}\)\s[^\n;]+;\s*)\n\s*(\(\d{4}\)\s[^\n]+)", r"\1 \2"),
    (r"(Vs\.)\s*\n\s*(?=[A-Z])", r"\1 "),
    (r"(\d{1,2})\.\s*\n\s*(\d{1,2}\.\s*\d{4})", r"\1. \2"),
    (r"(?i)\?\s*\n\s*(yes|no)([.,])\s+(?=[A-Z])", r"? \1\2\n"),
    (r"(?i)\?\s*\n\s*(yes|no)\s+(?=[A-Z])", r"? \1.\n"),
    (r"\b(Act)\.\s+(?=(?!of\b|or\b|on\b|and\b|to\b)[A-Z])", r"\1.\n"),
    (r"(Code|Card|Town|Sudu|notes)[.;]\s+(?=[A-Za-z0-9\(])", r"\1.\n"),
    (r"(?:\n\s*)?(\[?\(?[Ee]mphasis added[\)\]]?)([.?!]?)\s+(?=[A-Z])", r"\1\2\n"),
    (r"\.\s*\n\s*”\s*(\[[Ee]mphasis added\])", r".” \1"),
    (r"""(^\s*[""'\.\-]{1,})\s*\n\s*([A-Z])""", r"\1 \2"),
    (r"(\(\d+\)\.)\s*\n\s*([A-Z])", r"\1 \2"),
    (r"([a-z])\n([a-z])", r"\1 \2"),
]
