"""Functions from columns to columns; all stay inside the JVM."""
