"""Hand-made catalog rows."""

from leafgrid.schemas import FILE

FOLDER = "application/vnd.google-apps.folder"
DOC = "application/vnd.google-apps.document"
SHEET = "application/vnd.google-apps.spreadsheet"
SLIDES = "application/vnd.google-apps.presentation"
FORM = "application/vnd.google-apps.form"


def file(id, name, parent=None, mime="text/plain", **more):
    row = {field: None for field in FILE.names}
    parents = parent if isinstance(parent, list) else [parent] if parent else None
    row.update(id=id, name=name, mimeType=mime, parents=parents, trashed=False)
    row.update(more)
    return row


def folder(id, name, parent=None, **more):
    return file(id, name, parent, FOLDER, **more)


def catalog(spark, rows):
    return spark.createDataFrame([tuple(r[f] for f in FILE.names) for r in rows], FILE)
