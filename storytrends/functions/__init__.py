"""Functions from columns to columns."""
