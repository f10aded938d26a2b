"""Packages written in a test: XML snippets in, zip bytes out."""
import io
import zipfile

from docaudit import constants as C

XMLNS = " ".join(f'xmlns:{p}="{uri}"' for uri, p in C.NS.items())


def root(name, inner):
    return f"<{name} {XMLNS}>{inner}</{name}>"


def package(body="", parts=None, drop=()):
    entries = {"[Content_Types].xml": "<Types/>", "word/document.xml": root("w:document", body)}
    entries |= parts or {}
    target = io.BytesIO()
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for name, xml in entries.items():
            if name not in drop:
                z.writestr(name, xml)
    return bytearray(target.getvalue())


def drawing(name="img", attrs="", frame="wp:inline", inner="<pic:pic><a:blip/></pic:pic>"):
    return (f'<w:drawing><{frame}><wp:docPr id="1" name="{name}" {attrs}/><a:graphic>{inner}'
            f"</a:graphic></{frame}></w:drawing>")


def p(inner, props=""):
    return f"<w:p>{props}<w:r>{inner}</w:r></w:p>"


def t(text):
    return p(f"<w:t>{text}</w:t>")
