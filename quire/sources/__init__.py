"""Sources and sinks: archives of books as tables of entries, style sheets, images, checker reports."""
