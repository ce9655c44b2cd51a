"""Readers of pages, attachments and files, and the table layer that stands for document and graph stores."""
