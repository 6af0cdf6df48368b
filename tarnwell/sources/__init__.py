"""Where pages come from and where tables go."""

from .tables import document_pages, load, page_rows, site_list, unique_pages

__all__ = ["document_pages", "load", "page_rows", "site_list", "unique_pages"]
