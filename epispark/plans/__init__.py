"""Logical plans: role resolution, recode + filters, and the register report."""
